import random

import pytest
from pyspark.sql import functions as F

from stillroom.llm.components import components


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for members in rows:
        ids = [x for x in members or [] if x is not None]
        for x in ids:
            a, b = find(ids[0]), find(x)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, rows):
    df = spark.createDataFrame([(r, "clash") for r in rows], "m array<bigint>, group_id string")
    got = components(df, F.col("m")).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.group_id for r in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    rows = [[rnd.randrange(300) if rnd.random() < 0.9 else None for _ in range(rnd.choice([0, 1, 2, 2, 3, 5]))] for _ in range(220)] + [None]
    assert run(spark, rows) == brute(rows)


def test_chain_hub_and_repeats(spark):
    chain = [[i, i + 1] for i in range(1, 120)]
    random.Random(0).shuffle(chain)
    hub = [[1000, i] for i in range(1001, 1300)] + [[5000, i] for i in range(4000, 4200)]
    rows = chain + hub + chain[:10] + [[9999]]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [[None, None]]) == {}


def test_hubs_get_their_minimum_by_broadcast(spark, monkeypatch):
    from stillroom.operators import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    hubs = [[7, i] for i in range(1000, 1400)] + [[i, 3] for i in range(1399, 1700)] + [[i, i + 1] for i in range(2000, 2060)]
    assert run(spark, hubs) == brute(hubs)
