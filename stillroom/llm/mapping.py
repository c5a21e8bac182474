"""Free-entered values mapped to a canonical list by token-level repair and soft TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillroom.sources.tables import cut

# Accented letters of the catalogue's languages and their plain form.
ACCENTED, PLAIN = "čćžšđáàâäãåéèêëíìîïóòôöõúùûüýñç", "cczsdaaaaaaeeeeiiiiooooouuuuync"
#: Reference tokens in one trie; a longer list is cut into tries of this size, each searched in turn. Also the rows of the list (a name's tokens) that are broadcast.
SHARD = 100_000


def tokens_of(value: Column) -> Column:
    """Words of letters, lower case, without accents, percent codes undone."""
    plain = F.translate(F.lower(F.coalesce(F.try_url_decode(value), value)), ACCENTED, PLAIN)
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(plain, "ß", "ss"), r"[^\p{L}]+", " "), " "), lambda t: t != "")


def joined_neighbours(tokens: Column) -> Column:
    """Each two neighbouring words as one, for spaces lost or moved by a letter."""
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def allowed(length: int) -> int:
    """How many slips a word of this length may hold."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 9 else 3


def near(trie: dict, word: str, most: int) -> list[tuple[str, int]]:
    """(token, distance) of the trie's tokens within ``most`` slips (a letter added, dropped, replaced or swapped with its neighbour).

    One row of the distance table for each trie node, shared by all tokens with that beginning, of which only the cells within reach of the diagonal are
    filled; a branch ends when its row has no value within reach.
    """
    out, n, far = [], len(word), most + 1
    stack = [(node, c, "", 1, [i if i <= most else far for i in range(n + 1)], None) for c, node in trie.items() if c]
    while stack:
        node, c, last, depth, above, above2 = stack.pop()
        row = [far] * (n + 1)
        if depth <= most:
            row[0] = depth
        least = row[0]
        for i in range(max(1, depth - most), min(n, depth + most) + 1):
            d = above[i - 1] + (word[i - 1] != c)
            if row[i - 1] < d - 1:
                d = row[i - 1] + 1
            if above[i] < d - 1:
                d = above[i] + 1
            if above2 is not None and i > 1 and word[i - 1] == last and word[i - 2] == c and above2[i - 2] + 1 < d:
                d = above2[i - 2] + 1
            row[i] = d
            if d < least:
                least = d
        if "" in node and row[n] <= most:
            out.append((node[""], row[n]))
        # A swap looks two rows back, so a row out of reach may still be crossed from the one above it.
        if least <= most or min(above) < most:
            stack.extend((below, k, c, depth + 1, row, above) for k, below in node.items() if k)
    return out


def repairs(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, token, similarity) for every reference token within reach of a distinct word; 1 less slips by the longer length."""

    def search(part: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trie: dict = {}
            for token in part:
                node = trie
                for c in token:
                    node = node.setdefault(c, {})
                node[""] = token
            longest = max(map(len, part), default=0) + 3
            for batch in batches:
                rows = [(w, t, 1 - d / max(len(w), len(t))) for w in batch["word"] if len(w) <= longest for t, d in near(trie, w, allowed(len(w) + 2)) if d <= allowed(max(len(w), len(t)))]
                yield pd.DataFrame(rows, columns=["word", "token", "similarity"])

        return run

    # A search is work, not data: few bytes that adaptive execution would put into one task, so the number of tasks is set here. By a hash of the word: by the
    # word itself the planner takes the grouping before it for the same exchange and drops the number.
    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = words.repartition(tasks, F.xxhash64("word"))
    parts = [words.mapInPandas(search(vocabulary[i : i + SHARD]), "word string, token string, similarity double") for i in range(0, max(1, len(vocabulary)), SHARD)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def map_values(values: DataFrame, key: str, value: str, entries: DataFrame, least: float = 0.55) -> DataFrame:
    """(key, entry_id, score, coverage, matched) for every row; entry_id is null if no entry is meant.

    ``entries`` (entry_id, name) is the canonical list, several names an entry allowed; its size is that of a reference list, not of the data, and it is
    read to the driver. Every distinct word of the values, and every two neighbours as one word, is joined to the list's words by edit distance. A
    name's coverage is the idf-weighted share of its words that were found, each weighted by its similarity; its rank is the soft TF-IDF cosine of
    name and repaired words. Names covered less than ``least`` aren't meant. Ties go to the heavier name, then to the smaller entry.

    Null and empty values are unmatched; repeated values are ranked once; values may have any length. An empty list matches nothing.
    """
    names = entries.where(F.col("name").isNotNull()).select("entry_id", tokens_of(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()
    names = names.select(F.xxhash64("entry_id", "words").alias("name_id"), "entry_id", "words")
    n = names.count()
    weights = names.select("name_id", F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.log(F.lit(n + 1.0) / F.count("*")).alias("idf"))
    parts = names.select("name_id", "entry_id", F.explode(F.array_distinct("words")).alias("token")).join(weights, "token")
    totals = parts.groupBy("name_id").agg(F.sum("idf").alias("mass"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    wide = names.where(F.size("words") > 1).select("name_id", "entry_id", F.explode(F.array_distinct(F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), "")))).alias("token"))
    # A name written as one word stands for all of its words.
    reference = parts.select("name_id", "entry_id", "token", "idf", F.lit(False).alias("whole")).unionByName(wide.join(totals, "name_id").select("name_id", "entry_id", "token", F.col("mass").alias("idf"), F.lit(True).alias("whole")))
    reference = cut(reference.join(totals, "name_id"))
    reference_rows = reference.count()
    vocabulary = sorted(r[0] for r in reference.select("token").distinct().collect())

    distinct = values.select(value).where(F.col(value).isNotNull()).distinct().select(value, tokens_of(F.col(value)).alias("words"))
    distinct = distinct.select(value, F.array_distinct("words").alias("single"), F.array_distinct(joined_neighbours(F.col("words"))).alias("double"))
    words = distinct.select(value, F.explode(F.filter(F.array_distinct(F.concat("single", "double")), lambda w: F.length(w) > 1)).alias("word"), "single")
    words = words.select(value, "word", F.array_contains("single", F.col("word")).alias("is_single"))
    # A word much commoner than the one it resembles is no misspelling of it but a word of its own.
    counted = words.groupBy("word").agg(F.count("*").alias("df"))
    fixed = repairs(counted.select("word"), vocabulary).join(counted, "word").join(counted.select(F.col("word").alias("token"), F.col("df").alias("token_df")), "token", "left")
    # If the values never write the list's word rightly there is nothing to compare with.
    fixed = fixed.where((F.col("word") == F.col("token")) | F.col("token_df").isNull() | (F.col("df") <= 3 * F.col("token_df"))).select("word", "token", "similarity")
    hits = words.join(fixed, "word").join(F.broadcast(reference) if reference_rows <= SHARD else reference, "token")
    # The norm of a value counts its own words that mean anything to the list, each by its best repair.
    own = hits.where("is_single and not whole").groupBy(value, "word").agg(F.max_by("idf", F.struct("similarity", "idf")).alias("idf")).groupBy(value).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("own_norm"))
    # A word stands for one word of a name only, and a name's word is found once.
    used = hits.groupBy(value, "name_id", "entry_id", "word", "whole", "mass", "norm").agg(F.max_by(F.struct("token", "idf", "similarity"), F.struct(F.col("idf") * F.col("similarity"), F.col("token"))).alias("u"))
    best = used.groupBy(value, "name_id", "entry_id", "u.token", "u.idf", "whole", "mass", "norm").agg(F.max("u.similarity").alias("s"))
    scored = best.groupBy(value, "name_id", "entry_id", "mass", "norm").agg(
        F.sum(F.when(~F.col("whole"), F.col("idf") * F.col("s"))).alias("part_mass"), F.sum(F.when(~F.col("whole"), F.col("idf") * F.col("idf") * F.col("s"))).alias("part_dot"), F.max(F.when(F.col("whole"), F.col("s"))).alias("whole_s"),
    )
    scored = scored.join(own, value, "left").withColumn("coverage", F.greatest(F.col("part_mass") / F.col("mass"), F.col("whole_s")))
    dot = F.greatest(F.col("part_dot"), F.col("whole_s") * F.col("norm") * F.col("norm"))
    scored = scored.withColumn("score", dot / (F.col("norm") * F.greatest(F.coalesce("own_norm", F.lit(0.0)), F.col("norm"))))
    order = F.struct(F.round("score", 9).alias("a"), F.round("coverage", 9).alias("b"), F.round("mass", 9).alias("c"), (-F.col("entry_id")).alias("d"))
    top = scored.where(F.col("coverage") >= least).groupBy(value).agg(F.max_by(F.struct("entry_id", "score", "coverage"), order).alias("m"))
    return values.select(key, value).join(top, value, "left").select(key, F.col("m.entry_id").alias("entry_id"), "m.score", "m.coverage", F.col("m").isNotNull().alias("matched"))
