import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_matching import jac, listings, pieces

from stillroom.operators import blocks
from stillroom.operators.blocks import components, firsts, likeness
from stillroom.operators.matching import MATCH, NEAR, copies, similar_keys, slim_classes


def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)


@pytest.mark.parametrize("least", [NEAR, MATCH])
def test_pairs_of_blocks_are_those_of_the_whole_bucket(spark, monkeypatch, least):
    copied = copies(listings(spark, 5, 200))
    classes = slim_classes(copied)
    rows = classes.collect()
    expected = set()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            variants = [sorted({w for w in r.key.split() if w == "noir"}) for r in (x, y)]
            shops = {c.source_id for r in (x, y) for c in r.copies}
            if (x.category_id, x.bucket) == (y.category_id, y.bucket) and variants[0] == variants[1] and len(shops) > 1:
                j, t = jac(set(x.key.split()), set(y.key.split())), jac(pieces(x.key), pieces(y.key))
                if j >= least or t >= least:
                    expected.add((x.category_id, x.bucket, *sorted((x.first_id, y.first_id)), round(j, 9), round(t, 9)))
    found = lambda: [(r.category_id, r.bucket, r.id_a, r.id_b, round(r.j, 9), round(r.t, 9)) for r in similar_keys(copied, classes, least).collect()]
    once = found()
    assert len(once) == len(expected) and set(once) == expected
    small_blocks(monkeypatch)
    monkeypatch.setattr(blocks, "STEP", 50)
    dealt = found()
    assert len(dealt) == len(expected) and set(dealt) == expected


def test_likeness_in_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(g, i, rnd.randint(1, 3), rnd.randint(1, 4), sorted(rnd.sample(range(9), rnd.randint(1, 4)))) for g in (1, 2) for i in range(100 * g, 100 * g + 40)]
    df = spark.createDataFrame(rows, "g int, product_id int, source_id int, n int, words array<bigint>")
    expected = {(g, i): sum(jac(set(w), set(v)) * m for h, k, t, m, v in rows if h == g and t != s) for g, i, s, n, w in rows}
    small_blocks(monkeypatch)
    got = {(r.g, r.product_id): r.likeness for r in likeness(df, ("g",), df.groupBy("g").agg(F.count("*").alias("n"))).collect()}
    assert all(abs(got.get(k, 0) - v) < 1e-9 for k, v in expected.items()) and set(got) <= set(expected)


def test_components_and_firsts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "STEP", 20)
    pairs = [(1, i, i + 1) for i in range(300)] + [(2, 9, i) for i in range(10, 90)] + [(2, 500, 501), (1, 700, 700)]
    random.Random(1).shuffle(pairs)
    got = {(r.g, r.node): r.label for r in components(spark.createDataFrame(pairs, "g int, a int, b int"), ("g",)).collect()}
    assert got == {(1, i): 0 for i in range(301)} | {(2, i): 9 for i in range(9, 90)} | {(2, 500): 500, (2, 501): 500, (1, 700): 700}
    rows = [(1, 0, 1, 5), (1, 0, 1, 6), (1, 1, 2, 6), (1, 1, 2, 7), (1, 2, 3, 7), (1, 2, 3, 8), (2, 0, 4, 5)]
    kept = firsts(spark.createDataFrame(rows, "c int, rank int, cluster int, product_id int"), "c", ("rank",), ("cluster",)).collect()
    assert {r.cluster for r in kept} == {1, 3, 4}
    assert components(spark.createDataFrame([], "g int, a int, b int"), ("g",)).count() == 0


def test_pieces_of_any_letters():
    import pyarrow as pa

    texts = ["", "a", "ab", "abc", "abcabc", "ž\U0001f600x ž"]
    row, code = blocks.pieces_of(pa.chunked_array([texts]))
    assert [len({*code[row == i].tolist()}) for i in range(len(texts))] == [len(pieces(t)) for t in texts]
    assert len(np.unique(code)) == len(set().union(*map(pieces, texts)))
