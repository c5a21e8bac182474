"""Groups from pairwise matches: connected components by seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillroom.operators.skew import join_values
from stillroom.sources.tables import cut


def star(members: Column) -> Column:
    """The undirected edges, both ways, that link an array of ids through its smallest, and a loop at every id, so that lone ids stay; each once."""
    ids = F.array_distinct(F.filter(members, lambda x: x.isNotNull()))
    hub = F.array_min(ids)
    return F.array_distinct(F.flatten(F.transform(ids, lambda x: F.array(F.struct(x.alias("u"), x.alias("v")), F.struct(x.alias("u"), hub.alias("v")), F.struct(hub.alias("u"), x.alias("v"))))))


def components(links: DataFrame, members: Column) -> DataFrame:
    """(id, group_id) for every id in ``members``, an array of ids for each row that links all of them; group_id is the smallest id of the group.

    Each round, every vertex tells its neighbours the smallest id it sees. A vertex that nobody then holds to be a minimum leaves the graph and hangs on
    the smallest minimum it was told, in the propagation forest; the other minima it was told are linked to that one, so nothing falls apart. The
    graph shrinks to its seeds in about log(n) rounds; then each seed's id flows down the forest, from the last round's level to the first's.

    Hub vertices: minima are combined before the shuffle, no vertex's neighbours are ever brought into one row, and a vertex with more than a thousandth of a
    round's rows gets its minimum to them by broadcast (``join_values``), so that its rows are never one task. Each round is cut with a checkpoint on shared
    storage. Null ids are ignored; a row without ids links nothing; an empty table gives no rows.
    """
    edges = cut(links.select(F.inline(star(members))))
    total = edges.count()
    levels: list[DataFrame] = []
    while True:
        # v hears the minimum of u; with its loop, u hears its own.
        smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        told = join_values(edges, smallest, "u", total).select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        told = cut(told)
        verdict = told.groupBy("x").agg(F.min("y").alias("best"), F.max((F.col("x") == F.col("y")).cast("int")).alias("stays"), F.count("*").alias("n"))
        # One row for each vertex of the round, with the vertex it hangs on, itself if it stays.
        levels.append(cut(verdict.select(F.col("x").alias("id"), F.when(F.col("stays") == 1, F.col("x")).otherwise(F.col("best")).alias("parent"))))
        rest = cut(join_values(told, verdict.select("x", "best", "n"), "x", total).where("y <> best").select(F.inline(star(F.array("y", "best")))))
        total = rest.count()
        if not total:
            break
        edges = rest
    # A vertex that stays in the last round it takes part in is a seed: its parent there is itself.
    named = levels.pop().select("id", F.col("parent").alias("group_id"))
    for level in reversed(levels):
        above = named.select(F.col("id").alias("parent"), "group_id")
        named = level.join(above, "parent", "left").select("id", F.coalesce("group_id", "parent").alias("group_id"))
    return named
