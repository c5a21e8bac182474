"""Quantities recorded in different units, stated in common ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillroom.functions.unicode import simple_plain
from stillroom.functions.units import cents, stated
from stillroom.sources.tables import cut


# Types as objects: a string would need a running session when the module is imported.
@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("piece_ml", "pieces", "eur_cents")]))
def read_units(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Content and price as the texts of a row state them; a unit string is segmented once in a worker."""
    volume_units: dict = {}
    price_units: dict = {}
    for titles, metadata, prices, currencies in batches:
        rows = []
        for t, m, p, c in zip(titles, metadata, prices, currencies, strict=True):
            ml, pieces = stated(t, m, volume_units)
            rows.append((ml, pieces, cents(simple_plain(p), c, price_units) if p else None))
        yield pd.DataFrame(rows, columns=["piece_ml", "pieces", "eur_cents"]).astype("Int64")


def common_units(products: DataFrame) -> DataFrame:
    """Adds common_ml (total content in ml) and common_cents (price in EUR cents) to listings.

    Both are null where no text states them. A null or empty text states nothing; if a title and its metadata differ, the one that states a pack wins,
    else the title. Rows are kept as they are, repeated ones too; columns of the same name are replaced.
    """
    seen = "__units"
    return (
        products.withColumn(seen, read_units("title", "metadata", "price_original", "currency"))
        .withColumn("common_ml", F.col(f"{seen}.piece_ml") * F.col(f"{seen}.pieces"))
        .withColumn("common_cents", F.col(f"{seen}.eur_cents"))
        .drop(seen)
    )


# Sizes in ml of the units in which a content may be recorded (tenths of a ml, ml, fl. oz., cl, dl, l) and in EUR cents of those of a price (lipa, cent, kuna, EUR).
RECORDED_ML = (0.1, 1.0, 29.5735, 10.0, 100.0, 1000.0)
RECORDED_CENTS = (100 / 753.45, 1.0, 100 / 7.5345, 100.0)


def learned(rows: DataFrame, group: list[str], recorded: str, stated: str, sizes: tuple[float, ...], level: Callable[[Column], Column]) -> DataFrame:
    """Rows with ``inferred``: what their recorded number is in common units, where it is above zero, by what the rows say that state both.

    A size is weighed by how often it explains the group's recorded numbers, times how common the amount that it gives is among all stated ones (``level`` maps
    amounts to what is counted). Decided once for each group and number; counts are combined before the shuffle. Ties go to the size first named.
    """
    value = F.col(recorded).cast("double")
    amounts = F.array(*[F.struct(F.lit(i).alias("i"), F.round(value * s).cast("bigint").alias("amount")) for i, s in enumerate(sizes)])
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in group]
    named = [f"__{c}" for c in group]
    both = rows.where(F.col(stated).isNotNull() & (value > 0))
    habit = both.select(*keys, F.col(stated).alias("s"), F.inline(amounts)).where(F.abs(F.col("amount") - F.col("s")) <= 0.005 * F.col("s")).groupBy(*named, "i").agg(F.count("*").alias("habit"))
    usual = rows.where(F.col(stated) > 0).groupBy(level(F.col(stated)).alias("level")).agg(F.count("*").alias("usual"))
    asked = rows.where(F.col(stated).isNull() & (value > 0)).select(*keys, F.col(recorded).alias("__n"), F.inline(amounts)).distinct().where("amount > 0").withColumn("level", level(F.col("amount")))
    weight = (F.coalesce("habit", F.lit(0)) + 0.01) * (F.coalesce("usual", F.lit(0)) + 0.01)
    best = asked.join(habit, [*named, "i"], "left").join(usual, "level", "left").groupBy(*named, "__n").agg(F.max_by("amount", F.struct(weight, -F.col("i"))).alias("inferred"))
    return rows.select("*", *keys).join(best.withColumnRenamed("__n", recorded), [*named, recorded], "left").drop(*named)


def all_in_common_units(products: DataFrame) -> DataFrame:
    """(id, common_ml, common_cents, ml_from, cents_from) for every listing: as its texts state them (``stated``), else from the recorded number by the scale that its shop
    (and currency) writes in (``recorded``), else null.

    A recorded 0 is no content; a recorded price of 0 is 0 cents. Rows are kept as they are, repeated ones too.
    """
    rows = cut(common_units(products.select("id", "source_id", "title", "metadata", "price_original", "currency", "volume_ml", "price")).select("id", "source_id", "currency", "volume_ml", "price", "common_ml", "common_cents"))
    volumes = learned(rows, ["source_id"], "volume_ml", "common_ml", RECORDED_ML, lambda x: x).withColumnRenamed("inferred", "__ml")
    # Prices are told apart by size: half octaves.
    prices = learned(volumes, ["source_id", "currency"], "price", "common_cents", RECORDED_CENTS, lambda x: F.round(2 * F.log2(x.cast("double"))).cast("bigint"))
    free = F.when(F.col("price") == 0, F.lit(0).cast("bigint"))
    source = lambda stated, other: F.when(F.col(stated).isNotNull(), "stated").when(other.isNotNull(), "recorded")
    worked_out = F.coalesce("inferred", free)
    return prices.select("id", F.coalesce("common_ml", "__ml").alias("common_ml"), F.coalesce("common_cents", worked_out).alias("common_cents"), source("common_ml", F.col("__ml")).alias("ml_from"), source("common_cents", worked_out).alias("cents_from"))


def misstated(products: DataFrame) -> DataFrame:
    """(product_id, field, common_value) of each number that is null or isn't what the listing's texts state in common units."""
    cases = F.array(
        F.when(F.col("common_ml").isNotNull() & ~F.col("volume_ml").cast("bigint").eqNullSafe(F.col("common_ml")), F.struct(F.lit("volume_ml").alias("field"), F.col("common_ml").alias("common_value"))),
        F.when(F.col("common_cents").isNotNull() & ~(F.col("price") * 100).cast("bigint").eqNullSafe(F.col("common_cents")), F.struct(F.lit("price").alias("field"), F.col("common_cents").alias("common_value"))),
    )
    pruned = products.select("id", "title", "metadata", "price_original", "currency", "volume_ml", "price")
    return common_units(pruned).select(F.col("id").alias("product_id"), F.inline(F.filter(cases, lambda x: x.isNotNull()))).distinct()
