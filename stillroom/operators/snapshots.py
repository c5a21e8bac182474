"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_rows(deliveries: DataFrame, number: str, key: str, order: str, values: list[str]) -> DataFrame:
    """One row for each delivery and key: the one with the greatest ``order`` (null counts least; on a tie the greatest values).

    The maximum of a struct is combined before the shuffle, so a key that comes a million times costs one row a task.
    """
    best = F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("__best")
    picked = deliveries.where(F.col(number).isNotNull() & F.col(key).isNotNull()).groupBy(number, key).agg(best)
    return picked.select(number, key, *[F.col(f"__best.{v}").alias(v) for v in values])


def changes(deliveries: DataFrame, number: str, key: str, order: str, values: list[str]) -> DataFrame:
    """(key, number, change, old_<value>, new_<value>) for every record added, removed or changed against the delivery before.

    EXCEPT ALL both ways removes identical rows; only the residues are joined, by key, and labelled. Nulls equal nulls. Deliveries follow each other
    in order of their numbers, gaps or not. Rows with a null key or number are left out; an empty table or a single delivery gives no rows.
    """
    now = current_rows(deliveries, number, key, order, values)
    # One row for each delivery: the order of deliveries, not of records.
    follows = deliveries.where(F.col(number).isNotNull()).select(number).distinct().withColumn("__next", F.lead(number).over(Window.orderBy(number))).where("__next is not null")
    before = now.join(follows, number).select(F.col("__next").alias(number), key, *values)
    later = now.join(follows.select(F.col("__next").alias(number)), number, "left_semi")
    gone, come = before.exceptAll(later), later.exceptAll(before)
    old = gone.select(number, key, F.lit(True).alias("__old"), *[F.col(v).alias(f"old_{v}") for v in values])
    new = come.select(number, key, F.lit(True).alias("__new"), *[F.col(v).alias(f"new_{v}") for v in values])
    label = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return old.join(new, [number, key], "full").select(key, number, label.alias("change"), *[f"old_{v}" for v in values], *[f"new_{v}" for v in values])
