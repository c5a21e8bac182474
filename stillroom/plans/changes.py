"""Queries on units, histories and deliveries over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillroom.operators.history import versions
from stillroom.operators.snapshots import changes
from stillroom.operators.units import all_in_common_units, misstated
from stillroom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return misstated(table(spark, d, "products"))


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """Content in ml and price in EUR cents of every listing that states or records them, and from which of both they are."""
    rows = table(spark, d, "products", "id", "source_id", "title", "metadata", "price_original", "currency", "volume_ml", "price")
    return all_in_common_units(rows).withColumnRenamed("id", "product_id")


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions(table(spark, d, "price_history", "product_id", "recorded_at", "price", "was_available"), "product_id", "recorded_at", ["price", "was_available"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_versions(spark, d).select("product_id", "valid_from_us")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "product_snapshots", "snapshot_no", "product_id", "last_seen_at", "price", "is_available")
    return changes(rows, "snapshot_no", "product_id", "last_seen_at", ["price", "is_available"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_changes(spark, d).select("product_id", "snapshot_no", "change")


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p5_found, p5_versions, p7_found, p7_changes)}

VERSIONS = """
WITH u AS (SELECT DISTINCT product_id, epoch_us(recorded_at) AS at_us, price, was_available FROM price_history),
w AS (SELECT *, row_number() OVER o AS n, lag(price) OVER o AS lp, lag(was_available) OVER o AS la FROM u WINDOW o AS (PARTITION BY product_id ORDER BY at_us)),
b AS (SELECT *, (n = 1 OR price IS DISTINCT FROM lp OR was_available IS DISTINCT FROM la) AS begins FROM w),
z AS (SELECT *, sum(begins::INT) OVER (PARTITION BY product_id ORDER BY at_us) AS version FROM b),
g AS (SELECT product_id, min(at_us) AS valid_from_us, max(at_us) AS last_seen_us, count(*)::BIGINT AS n_updates, any_value(price) AS price, any_value(was_available) AS was_available FROM z GROUP BY product_id, version)
"""
DELIVERIES = """
WITH s AS (SELECT snapshot_no, product_id, price, is_available FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, product_id ORDER BY last_seen_at DESC NULLS LAST) AS k FROM product_snapshots) WHERE k = 1),
j AS (SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.snapshot_no, b.snapshot_no + 1) AS snapshot_no,
        CASE WHEN b.product_id IS NULL THEN 'added' WHEN a.product_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
        b.price AS old_price, b.is_available AS old_is_available, a.price AS new_price, a.is_available AS new_is_available
      FROM s a FULL JOIN s b ON a.product_id = b.product_id AND a.snapshot_no = b.snapshot_no + 1
      WHERE coalesce(a.snapshot_no, b.snapshot_no + 1) BETWEEN 2 AND (SELECT max(snapshot_no) FROM product_snapshots)
        AND (a.product_id IS NULL OR b.product_id IS NULL OR a.price IS DISTINCT FROM b.price OR a.is_available IS DISTINCT FROM b.is_available))
"""

ORACLES = {
    "p5_found": VERSIONS + "SELECT product_id, valid_from_us FROM g",
    "p5_versions": VERSIONS + "SELECT product_id, valid_from_us, lead(valid_from_us) OVER (PARTITION BY product_id ORDER BY valid_from_us) AS valid_to_us, last_seen_us, n_updates, price, was_available FROM g",
    "p7_found": DELIVERIES + "SELECT product_id, snapshot_no, change FROM j",
    "p7_changes": DELIVERIES + "SELECT * FROM j",
}
