"""Queries of this subpackage's operators over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillroom.llm.components import components
from stillroom.llm.confusables import disguised, normalized
from stillroom.llm.leakage import leaks
from stillroom.llm.mapping import map_values
from stillroom.llm.mixing import Mix, mix
from stillroom.llm.quality import judged, known_words, text_statistics, train
from stillroom.llm.titles import pairs_within, product_groups
from stillroom.sources.tables import cut, table

SHOPS = ("ecuga_id", "cugaklik_id", "promili_id", "diskontfumar_id", "rotodinamic_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its product group."""
    # The canonical aliases are a reference list, not data that grows with the listings.
    aliases = [r["alias"] for r in table(spark, d, "category_aliases", "alias").where("alias is not null").collect()]
    listings = table(spark, d, "products", "id", "title", "normalized_title", "volume_ml", "metadata")
    return product_groups(listings, aliases).select(F.col("id").alias("product_id"), "group_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(p2_groups(spark, d).withColumnRenamed("product_id", "id"))


def mapped(spark: SparkSession, d: str) -> DataFrame:
    categories = table(spark, d, "categories", "id", "name", "display_name", "slug")
    names = table(spark, d, "category_aliases").select(F.col("category_id").alias("entry_id"), F.col("alias").alias("name")).unionByName(categories.select(F.col("id").alias("entry_id"), F.explode(F.array("name", "display_name", "slug")).alias("name")))
    rows = table(spark, d, "source_category_mappings", "id", "file_slug", "canonical_category_id")
    known = categories.select(F.col("id").alias("canonical_category_id"))
    todo = rows.where("canonical_category_id is null").unionByName(rows.where("canonical_category_id is not null").join(known, "canonical_category_id", "left_anti").select(*rows.columns))
    return map_values(todo, "id", "file_slug", names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select(F.col("id").alias("mapping_id"), F.coalesce("entry_id", F.lit(0)).cast("int").alias("category_id"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry."""
    rows = table(spark, d, "source_category_mappings", "id", "source_id", "file_slug")
    return mapped(spark, d).where("not matched").select("id").join(rows, "id").select(F.col("id").alias("mapping_id"), "source_id", "file_slug")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return disguised(table(spark, d, "products", "id", "title", "normalized_title"), "id", ["title", "normalized_title"]).select(F.col("id").alias("product_id"), "field")


def p4_normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalized(table(spark, d, "products", "id", "title", "normalized_title"), ["title", "normalized_title"]).withColumnRenamed("id", "product_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "possible_matches", *SHOPS, "review_status").where(~F.col("review_status").eqNullSafe("rejected"))
    return components(rows, F.array(*SHOPS)).select(F.col("id").alias("product_id"), "group_id")


def p6_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("group_id").agg(F.count("*").alias("listings"))


def leak_rows(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text", "answer"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_rows(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, how often and how far."""
    found = leak_rows(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run_words").alias("longest_run"), F.count_if("answer_found").alias("with_answer"), F.count_if(F.col("leak") == "whole").alias("whole"))
    return found.join(table(spark, d, "eval_items", "item_id", "suite"), "item_id")


def mixture(spark: SparkSession, d: str) -> Mix:
    return mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).chosen


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).reached()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, calibrated probabilities and kind of every document."""
    words = table(spark, d, "common_words")
    stats = cut(text_statistics(table(spark, d, "documents", "doc_id", "text"), words))
    return judged(stats, train(stats, known_words(words)))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_unmatched, p4_found, p4_normalized, p6_found, p6_group_sizes, p8_found, p8_leaked_items, p9_mix, p9_shares, p10_found, p10_statistics)}

COMPONENTS = f"""
WITH RECURSIVE named AS (SELECT id AS row_id, unnest([{", ".join(SHOPS)}]) AS p FROM possible_matches WHERE review_status IS DISTINCT FROM 'rejected'),
v AS (SELECT DISTINCT row_id, p FROM named WHERE p IS NOT NULL),
hub AS (SELECT row_id, min(p) AS h FROM v GROUP BY row_id),
e AS (SELECT DISTINCT v.p AS a, hub.h AS b FROM v JOIN hub USING (row_id) UNION SELECT DISTINCT hub.h, v.p FROM v JOIN hub USING (row_id)),
r(p, g) AS (SELECT DISTINCT p, p FROM v UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.p WHERE r.g <= e.b),
c AS (SELECT p AS product_id, min(g) AS group_id FROM r GROUP BY p)
"""

ORACLES = {
    "p6_found": COMPONENTS + "SELECT product_id, group_id FROM c",
    "p6_group_sizes": COMPONENTS + "SELECT group_id, count(*)::BIGINT AS listings FROM c GROUP BY group_id",
}
