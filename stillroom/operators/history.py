"""Validity periods from updates or snapshots, by tree-reduction coalescing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillroom.sources.tables import cut


def run_starts(entity: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """Which unit intervals, sorted by entity and time, begin a run: neighbouring blocks of 1, 2, 4, ... units are merged pairwise, and where two
    blocks meet, the right one's first run is absorbed if entity and payload are equal. Each border is met once, after log2(n) rounds all are; as the blocks of
    a slice lie side by side, a merge is one comparison at their border. Between slices, runs themselves are merged (``merged_pairs``)."""
    n, width = len(entity), 1
    begins = np.ones(n, dtype=bool)
    while width < n:
        border = np.arange(width, n, 2 * width)
        begins[border] = (entity[border] != entity[border - 1]) | (payload[border] != payload[border - 1])
        width *= 2
    return begins


def coalesce_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one sorted slice. Of each batch the last run stays open until the next batch shows how it goes on; memory holds one batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.cast(pa.schema([f.with_nullable(True) for f in table.schema]))
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        entity = table["__entity"].to_numpy()
        payload = table["__key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(run_starts(entity, payload))
        last = np.append(first[1:] - 1, len(table) - 1)
        runs = table.take(pa.array(first))
        follows = np.append(entity[first[1:]] == entity[first[:-1]], False) if len(first) else np.array([], dtype=bool)
        start = runs["__from_us"].to_numpy()
        runs = runs.set_column(runs.schema.get_field_index("__last_us"), "__last_us", pa.array(table["__last_us"].to_numpy()[last]))
        runs = runs.set_column(runs.schema.get_field_index("__units"), "__units", pa.array(np.add.reduceat(table["__units"].to_numpy(), first)))
        runs = runs.set_column(runs.schema.get_field_index("__to_us"), "__to_us", pa.array(np.append(start[1:], 0), mask=~follows))
        held = runs.slice(len(runs) - 1)
        yield from runs.slice(0, len(runs) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def versions(updates: DataFrame, entity: str, at: str, payload: list[str], slices: int | None = None) -> DataFrame:
    """One row for each version: entity, valid_from_us, valid_to_us (null while it holds), last_seen_us, n_updates and the payload columns.

    Updates become unit intervals, one for each entity and time (repeated deliveries fall together before the shuffle; if they disagree, the greatest
    payload counts). The intervals are range-partitioned by (entity, time), so that an entity with a third of all rows is spread over many slices;
    each slice merges neighbouring runs pairwise, then the slices themselves are merged pairwise over log2(slices) rounds, in which only the
    first and last run of a slice take part. What is broadcast afterwards has at most two rows a slice.

    Rows with a null entity or time belong to no period and are left out; null payloads are values like others; an empty table gives no rows. The
    entity must be an integer column.
    """
    slices = slices or int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = F.struct(*[F.col(c) for c in payload])
    units = (
        updates.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(entity).alias("__entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("__from_us")).agg(F.max(values).alias("v"))
        .select(
            "__entity", "__from_us", F.col("__from_us").alias("__last_us"), F.lit(None).cast("bigint").alias("__to_us"), F.lit(1).cast("bigint").alias("__units"),
            F.to_json(F.struct(*[F.col(f"v.{c}").cast("string").alias(f"c{i}") for i, c in enumerate(payload)]), {"ignoreNullFields": "false"}).alias("__key"),
            F.struct(*[F.col(f"v.{c}").alias(c) for c in payload]).alias("__payload"),
        ).select("__entity", "__from_us", "__last_us", "__to_us", "__units", "__key", "__payload.*")
    )
    sliced = units.repartitionByRange(slices, "__entity", "__from_us").sortWithinPartitions("__entity", "__from_us")
    runs = cut(sliced.mapInArrow(coalesce_slice, sliced.schema).withColumn("__slice", F.spark_partition_id()))

    edge = F.struct(F.col("__slice").alias("slice"), F.col("__entity").alias("entity"), F.col("__from_us").alias("from_us"), F.col("__last_us").alias("last_us"), F.col("__units").alias("units"), F.col("__key").alias("payload"))
    order = F.struct("__entity", "__from_us")
    edges = cut(runs.groupBy("__slice").agg(F.min_by(edge, order).alias("head"), F.max_by(edge, order).alias("tail")))
    absorbed = absorbed_heads(edges, slices)
    gone = F.broadcast(absorbed.select(F.col("slice").alias("__slice"), F.col("entity").alias("__entity"), F.col("from_us").alias("__from_us")))
    kept = runs.join(gone, ["__slice", "__entity", "__from_us"], "left_anti")
    longer = absorbed.groupBy(F.col("entity").alias("__entity"), F.col("root_us").alias("__from_us")).agg(F.max("last_us").alias("x_last"), F.sum("units").alias("x_units"))
    # An entity that lies in several slices is at the head of all but the first of them.
    several = edges.select(F.col("head.entity").alias("__entity")).distinct()
    starts = kept.join(F.broadcast(several), "__entity", "left_semi").groupBy("__entity", "__slice").agg(F.min("__from_us").alias("first_us"))
    ahead = starts.withColumn("next_us", F.lead("first_us").over(Window.partitionBy("__entity").orderBy("__slice"))).select("__entity", "__slice", "next_us").where("next_us is not null")
    whole = kept.join(F.broadcast(longer), ["__entity", "__from_us"], "left").join(F.broadcast(ahead), ["__entity", "__slice"], "left")
    return whole.select(
        F.col("__entity").alias(entity), F.col("__from_us").alias("valid_from_us"), F.coalesce("__to_us", "next_us").alias("valid_to_us"),
        F.greatest("__last_us", "x_last").alias("last_seen_us"), (F.col("__units") + F.coalesce("x_units", F.lit(0))).alias("n_updates"), *payload,
    )


GONE = "array<struct<slice:int,entity:bigint,from_us:bigint,last_us:bigint,units:bigint,root_us:bigint>>"


def absorbed_heads(edges: DataFrame, slices: int) -> DataFrame:
    """(slice, entity, from_us, last_us, units, root_us) of the runs that go on with a run of an earlier slice; root_us is where that run began.

    Blocks of slices are merged pairwise in log2(slices) rounds. A block carries its first and last run, the start of the run that its last one goes
    on with, and what it absorbed so far; when two blocks meet in one run, all that hung on the right block's head hangs on the left block's root.
    """
    blocks = edges.select(F.col("__slice").alias("block"), "head", "tail", F.col("tail.from_us").alias("root"), F.array().cast(GONE).alias("gone"))
    width = 1
    while width < slices:
        blocks, width = merged_pairs(blocks), 2 * width
    return blocks.select(F.inline("gone"))


def merged_pairs(blocks: DataFrame) -> DataFrame:
    """One round: blocks 2i and 2i + 1 become block i."""
    pairs = blocks.groupBy(F.floor(F.col("block") / 2).cast("int").alias("pair")).agg(F.sort_array(F.collect_list(F.struct("block", "head", "tail", "root", "gone"))).alias("s"))
    a, b, two = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2)), F.size("s") == 2
    meet = two & (a["tail"]["entity"] == b["head"]["entity"]) & (a["tail"]["payload"] == b["head"]["payload"])

    def rehung(g):
        return F.when((g["entity"] == b["head"]["entity"]) & (g["root_us"] == b["head"]["from_us"]), g.withField("root_us", a["root"])).otherwise(g)

    joint = F.array(F.struct(*[b["head"][c].alias(c) for c in ("slice", "entity", "from_us", "last_us", "units")], a["root"].alias("root_us"))).cast(GONE)
    through = meet & (b["root"] == b["head"]["from_us"]) & (b["tail"]["entity"] == b["head"]["entity"])
    return pairs.select(
        F.col("pair").alias("block"), a["head"].alias("head"), F.when(two, b["tail"]).otherwise(a["tail"]).alias("tail"),
        F.when(two & ~through, b["root"]).otherwise(a["root"]).alias("root"),
        F.when(meet, F.concat(a["gone"], joint, F.transform(b["gone"], rehung))).when(two, F.concat(a["gone"], b["gone"])).otherwise(a["gone"]).alias("gone"),
    )


def previous_values(rows: DataFrame, entity: str, order: list[str], value: str, slot: Column) -> DataFrame:
    """Rows with ``before``, the value of the row before in its entity's order; null for the first.

    ``slot`` cuts time into pieces that follow each other as the order does (a day, say). Each piece of an entity is sorted by itself, so an entity with a third of
    all rows is as many tasks as it has pieces; from piece to piece only the last value goes on, one row each. Null values are values; rows with a null entity are left out.
    """
    slotted = rows.withColumn("__slot", slot)
    inside = Window.partitionBy(entity, "__slot").orderBy(*order)
    last = slotted.groupBy(entity, "__slot").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(entity).orderBy("__slot"))).select(F.col(entity).alias("__entity"), F.col("__slot").alias("__at"), "__carried")
    numbered = slotted.withColumn("__k", F.row_number().over(inside)).withColumn("__inside", F.lag(value).over(inside))
    both = numbered.join(carried, (F.col(entity) == F.col("__entity")) & F.col("__slot").eqNullSafe(F.col("__at")))
    return both.select(*rows.columns, F.when(F.col("__k") == 1, F.col(f"__carried.{value}")).otherwise(F.col("__inside")).alias("before"))
