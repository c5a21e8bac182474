"""Bytes that queries of the matcher put on disk: shuffled and checkpointed files, against those of the listings."""

import os
from pathlib import Path

import pytest

from stillroom.plans.matching import QUERIES
from stillroom.sources.tables import use_checkpoint_dir

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")


def files(spark):
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {p: p.stat().st_size for d in (*local, use_checkpoint_dir(spark).removeprefix("file:")) for p in Path(d).rglob("*") if p.is_file()}


@pytest.mark.parametrize(
    "name",
    [
        "new_matches",
        "suggestion_counters",
        "suggested_clusters",
        "suggestion_queue",
        "consensus_pairs",
        "match_components",
        "matcher_examples",
        "pair_kinds",
        "run_counters",
        "suggested_clusters_high_floor",
        "all_scored_pairs",
        "cluster_histogram",
        "matcher_agreement",
        "matcher_summary",
        "pair_kinds_high_floor",
        "run_summary",
        "cluster_labels",
        "match_clusters",
        "matcher_disagreements",
        "matches_beside_confirmed",
    ],
)
def test_little_is_written(spark, name):
    before = files(spark)
    QUERIES[name](spark, DATA).collect()
    written = sum(size for p, size in files(spark).items() if p not in before)
    print(name, written)
    assert written < 8 * os.path.getsize(f"{DATA}/products.parquet")
