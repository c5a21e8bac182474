"""Bytes that queries of the matcher put on disk where many listings without a content belong to every bucket."""

import os

import pytest
from pyspark.sql import functions as F
from test_disk import files

from stillroom.plans.matching import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """The listings with two of five without a content, the others in 60 contents."""
    d = str(tmp_path_factory.mktemp("spread"))
    rows = spark.read.parquet(f"{DATA}/products.parquet")
    content = F.when(F.col("id") % 5 > 1, 100 + F.col("id") % 60).cast("int")
    rows.withColumns({"volume_ml": content, "category_id": F.when(F.col("category_id").isNotNull(), F.lit(1))}).coalesce(1).write.parquet(f"{d}/products.parquet")
    for name in ("sources", "possible_matches"):
        os.symlink(f"{DATA}/{name}.parquet", f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize(
    "name, most",
    [
        ("consensus_pairs", 3),
        ("match_components", 6),
        ("matcher_examples", 3),
        ("pair_kinds", 6),
        ("run_counters", 6),
        ("all_scored_pairs", 6),
        ("cluster_histogram", 6),
        ("matcher_agreement", 3),
        ("matcher_summary", 3),
        ("pair_kinds_high_floor", 6),
        ("run_summary", 6),
        ("suggestion_counters", 6),
        ("cluster_labels", 6),
        ("match_clusters", 6),
        ("matcher_disagreements", 3),
        ("matches_beside_confirmed", 6),
    ],
)
def test_listings_without_content_are_moved_once(spark, spread, name, most):
    before, size = files(spark), sum(os.path.getsize(f"{spread}/products.parquet/{p}") for p in os.listdir(f"{spread}/products.parquet"))
    QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
    written = sum(n for p, n in files(spark).items() if p not in before)
    print(name, round(written / size, 2))
    assert written < most * size
