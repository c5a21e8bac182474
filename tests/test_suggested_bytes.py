"""Bytes that suggestions shuffle where many listings without a content belong to every bucket."""

import pytest
from test_spread import pytestmark, spread  # noqa: F401

from stillroom.plans.matching import QUERIES


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name, most", [("suggested_clusters", 6), ("suggested_clusters_high_floor", 6), ("suggestion_queue", 6)])
def test_suggestions_shuffle_little(spark, spread, name, most):  # noqa: F811
    import os

    before, size = shuffled(spark), sum(os.path.getsize(f"{spread}/products.parquet/{p}") for p in os.listdir(f"{spread}/products.parquet"))
    QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
    written = shuffled(spark) - before
    print(name, round(written / size, 2))
    assert written < most * size
