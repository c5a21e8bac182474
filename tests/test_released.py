"""Shuffled files that a query of the matcher still holds when its cuts are made, and rows of large clusters that it moves."""

import gc
import os
import random
import time

import pytest
from test_disk import DATA, files
from test_suggested_bytes import shuffled

from stillroom.operators import blocks
from stillroom.operators.matching import one_of_each_shop
from stillroom.plans.matching import QUERIES


def held(spark):
    return sum(n for p, n in files(spark).items() if p.name.startswith("shuffle_"))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["matcher_examples", "suggested_clusters_high_floor"])
def test_cuts_leave_no_shuffled_files(spark, name):
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)
    before, rows = held(spark), QUERIES[name](spark, DATA)
    until = time.time() + 10
    while (left := held(spark) - before) > 200_000 and time.time() < until:
        time.sleep(0.1)
    print(name, left)
    assert left <= 200_000 and rows.columns


def test_large_clusters_are_moved_as_keys(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(1, i, rnd.randint(1, 3), 1, " ".join(rnd.sample(words, rnd.randint(0, 6)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, product_id int, source_id int, n int, key string").localCheckpoint()
    whole = {tuple(r) for r in one_of_each_shop(df, ("g",)).collect()}
    monkeypatch.setattr(blocks, "BLOCK", 100)
    before = shuffled(spark)
    dealt = {tuple(r) for r in one_of_each_shop(df, ("g",)).collect()}
    moved = shuffled(spark) - before
    print(moved)
    assert dealt == whole and len(whole) == 3 and moved < 2_500_000
