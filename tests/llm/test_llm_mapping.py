import random

import pytest

from stillroom.llm.mapping import allowed, map_values, near


def distance(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_search_is_edit_distance():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(120)})
    trie = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    for _ in range(150):
        q, most = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))), rnd.randint(0, 3)
        assert sorted(near(trie, q, most)) == sorted((w, distance(q, w)) for w in words if distance(q, w) <= most)


@pytest.fixture(scope="module")
def entries(spark):
    names = [(1, "whisky"), (1, "bourbon"), (2, "gin"), (10, "bijelo vino"), (11, "crno vino"), (16, "stout"), (21, "gazirana pica"), (27, "gorki likeri"), (8, "likeri"), (24, "bez alkohola"), (9, None)]
    return spark.createDataFrame(names, "entry_id int, name string")


def test_map(spark, entries):
    cases = {
        "shop/wrisky": 1, "zestoka-pica-whisyk-1": 1, "alk,BIJELA": None, "sve-bijelov_ino": 10, "CRNOVINO": 11, "vino%20crno.html": 11, "grki-likeri": 27, "likeri-online": 8, "b-alkohola": 24, "knjige": None, "zestoka-pica-knjige": None, "snout": 16, "": None,
        "filter": None, "100%": None, "giin": 2,
    }
    rows = [(i, v, "clash") for i, v in enumerate([*cases, None, "shop/wrisky"])]
    got = {r.id: r.entry_id for r in map_values(spark.createDataFrame(rows, "id int, slug string, token string"), "id", "slug", entries).collect()}
    assert [got[i] for i in range(len(cases))] == [*cases.values()]
    assert got[len(cases)] is None and got[len(cases) + 1] == 1


def test_empty(spark, entries):
    df = spark.createDataFrame([(1, "gin")], "id int, slug string")
    assert map_values(df.limit(0), "id", "slug", entries).count() == 0
    assert [r.entry_id for r in map_values(df, "id", "slug", entries.limit(0)).collect()] == [None]


def test_long_value(spark, entries):
    df = spark.createDataFrame([(1, "x" * 50_000 + "-gin")], "id int, slug string")
    assert [r.entry_id for r in map_values(df, "id", "slug", entries).collect()] == [2]
    assert allowed(2) == 0


def test_search_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from stillroom.llm.mapping import repairs

    words = spark.range(400).select(F.concat(F.lit("w"), F.col("id")).alias("word")).groupBy("word").count().select("word")
    found = repairs(words, ["whisky"])
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_list_word_that_nobody_writes_rightly_is_still_found(spark, entries):
    # Five values misspell it in the same way, none writes it rightly.
    df = spark.createDataFrame([(i, f"shop{c}/gorkii-likerri") for i, c in enumerate("abcde")], "id int, slug string")
    assert {r.entry_id for r in map_values(df, "id", "slug", entries).collect()} == {27}
