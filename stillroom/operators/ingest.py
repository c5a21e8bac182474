"""Landed listings merged into the current state: last write wins, unseen listings of the scope go out of stock, and every change is recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writes(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by order. The row is packed into a struct and the greatest kept, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    packed = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])).alias("__last")
    return rows.groupBy(*key).agg(packed).select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def merged(state: DataFrame, landed: DataFrame, key: list[str], scope: list[str], now: Column, fields: tuple[str, ...] = (), touched: str | None = None, counter: str | None = None) -> DataFrame:
    """The state after a landing: (key, price, is_available, last_seen_at, outcome, old_price, old_available) and what is asked for.

    One full join. A landed listing is inserted or overwritten, available and seen now; a listing of the state that isn't landed becomes unavailable
    if it was available and its ``scope`` columns name a group that was landed at all; others stay. outcome is inserted, updated, deactivated
    or kept. ``fields`` are overwritten by a landed listing like the price; ``touched`` names a column that gets the time of every change; ``counter`` one that
    counts how often a listing went out of stock. ``landed`` must have one row for each key (``last_writes``). Null prices are values; rows with a null key
    part are kept apart.
    """
    covered = landed.select(*scope).distinct().withColumn("__covered", F.lit(True))
    extra = [*fields, *([touched] if touched else []), *([counter] if counter else [])]
    old = state.join(covered, scope, "left").select(*key, F.col("price").alias("old_price"), F.col("is_available").alias("old_available"), F.col("last_seen_at").alias("old_seen_at"), *[F.col(c).alias(f"__old_{c}") for c in extra], F.coalesce("__covered", F.lit(False)).alias("__covered"), F.lit(True).alias("__old"))
    new = landed.select(*key, F.col("price").alias("__price"), *[F.col(c).alias(f"__new_{c}") for c in fields], F.lit(True).alias("__new"))
    both = old.join(new, key, "full")
    gone = F.col("__new").isNull() & F.col("__covered") & F.col("old_available")
    outcome = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new"), "updated").when(gone, "deactivated").otherwise("kept")
    return both.select(
        *key, F.when(F.col("__new"), F.col("__price")).otherwise(F.col("old_price")).alias("price"), F.when(F.col("__new"), True).when(gone, False).otherwise(F.col("old_available")).alias("is_available"),
        F.when(F.col("__new"), now).otherwise(F.col("old_seen_at")).alias("last_seen_at"), outcome.alias("outcome"), "old_price", "old_available",
        *[F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}")).alias(c) for c in fields],
        *([F.when(outcome == "kept", F.col(f"__old_{touched}")).otherwise(now).alias(touched)] if touched else []),
        *([(F.coalesce(f"__old_{counter}", F.lit(0)) + F.when(gone, 1).otherwise(0)).alias(counter)] if counter else []),
    )


def without_shops(gone: DataFrame, products: DataFrame, history: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, history, members) after the shops of ``gone`` (source_id) are removed: their listings go, the listings' history with them, and match members (match_id,
    source_id, product_id) that named them are emptied, not their matches."""
    kept = products.join(gone.select("source_id").distinct(), "source_id", "left_anti")
    dead = products.join(gone.select("source_id").distinct(), "source_id", "left_semi").select(F.col("id").alias("product_id"))
    return kept, history.join(dead, "product_id", "left_anti"), members.join(dead, "product_id", "left_anti")


def without_categories(gone: DataFrame, products: DataFrame) -> DataFrame:
    """Products after the categories of ``gone`` (category_id) are removed: their listings stay and have none."""
    marked = products.join(gone.select("category_id").distinct().withColumn("__gone", F.lit(True)), "category_id", "left")
    return marked.withColumn("category_id", F.when(F.col("__gone").isNull(), F.col("category_id"))).select(*products.columns)


def recorded_changes(after: DataFrame, key: list[str]) -> DataFrame:
    """History rows of a merge: new price and availability of every listing of the state where one of them differs; a null on either side is no difference, a
    first insert no change."""
    differs = (F.col("old_price") != F.col("price")) | (F.col("old_available") != F.col("is_available"))
    return after.where((F.col("outcome") != "inserted") & F.coalesce(differs, F.lit(False))).select(*key, "price", F.col("is_available").alias("was_available"))


def backfilled(current: DataFrame, previous: DataFrame, title: str, image: str, order: str) -> DataFrame:
    """Missing images taken from the previous landing by equal title; of a title's several rows the last by order counts."""
    last = previous.where(F.col(image).isNotNull()).groupBy(title).agg(F.max_by(image, order).alias("__image"))
    return current.join(last, title, "left").withColumn(image, F.coalesce(image, "__image")).drop("__image").select(*current.columns)
