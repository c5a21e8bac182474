"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many keys can be heavy at most, and from how many rows on a key can be.
HEAVY_KEYS, HEAVY_ROWS = 1_000, 10_000


def heavy_bound(total: int) -> int:
    """Rows of a key beyond which it is heavy: of ``total`` rows at most HEAVY_KEYS keys can have more, which bounds what is broadcast."""
    return max(HEAVY_ROWS, -(-total // HEAVY_KEYS))


def join_values(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Rows joined to the one row of their key in ``values``, whose column n says how many of the rows carry the key; n is dropped.

    ``total`` is a number that the rows don't exceed. Rows of heavy keys stay where they are and get their values by broadcast; only the others are shuffled. Keys
    without a row in ``values`` and null keys are left out.
    """
    bound = heavy_bound(total)
    heavy, light = F.broadcast(values.where(F.col("n") > bound).drop("n")), values.where(F.col("n") <= bound).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))
