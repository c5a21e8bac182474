"""Bytes that queries of the matcher shuffle where buckets have many blocks: rows are moved once, not once for each of their group's blocks."""

import os

import pytest
from test_spread import pytestmark, spread  # noqa: F401
from test_suggested_bytes import shuffled

from stillroom.operators import blocks
from stillroom.plans.matching import QUERIES


@pytest.mark.parametrize(
    "name, most",
    [
        ("match_components", 4),
        ("pair_kinds", 4),
        ("suggested_clusters_high_floor", 6),
        ("all_scored_pairs", 4),
        ("cluster_histogram", 6),
        ("matcher_agreement", 3.4),
        ("matcher_summary", 3.4),
        ("pair_kinds_high_floor", 4),
        ("run_summary", 6),
        ("cluster_labels", 6),
        ("match_clusters", 6),
        ("matcher_disagreements", 3.4),
        ("matches_beside_confirmed", 6),
        ("suggestion_queue", 6),
    ],
)
def test_blocks_are_moved_once(spark, spread, monkeypatch, name, most):  # noqa: F811
    monkeypatch.setattr(blocks, "BLOCK", 25)
    before, size = shuffled(spark), sum(os.path.getsize(f"{spread}/products.parquet/{p}") for p in os.listdir(f"{spread}/products.parquet"))
    QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
    written = shuffled(spark) - before
    print(name, round(written / size, 2))
    assert written < most * size
