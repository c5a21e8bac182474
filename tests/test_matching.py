import itertools
import random

import pytest
from pyspark.sql import functions as F

from stillroom.functions.titles import match_tokens, normalized_title
from stillroom.operators.graph import smallest_label
from stillroom.operators.matching import COMPARED, Rules, agreement, bucketed, candidates, chained, clusters, cosine_pairs, disjoint, edges, idf, key_classes, match_rows, matcher_pairs, measured, pair_classes, scored_pairs, shared_words, similarity_pairs, suggestions, typical

SCHEMA = "id int, source_id int, category_id int, title string, volume_ml int, is_available boolean, key string"
WORDS = "alpha beta gamma delta omega reserve noir 12 18 gold silver kappa sigma".split()


def listings(spark, seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 4)))
        rows.append((i, rnd.randint(1, 5), rnd.choice([1, 1, 2, None]), rnd.choice([title, title, None]) if rnd.random() < 0.1 else title, rnd.choice([700, 1000, None]), rnd.random() < 0.9, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def jac(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def pieces(key):
    return set() if not key else {key} if len(key) < 3 else {key[i : i + 3] for i in range(len(key) - 2)}


@pytest.mark.parametrize("least", [0.37, 0.7])
def test_candidates_lose_no_pair(spark, least):
    classes = key_classes(bucketed(listings(spark, 1))).cache()
    rows = classes.collect()
    assert all(len(r.words) == len(set(r.key.split())) and len(r.pieces) == len(pieces(r.key)) for r in rows)
    found = {(r.a, r.b) for r in candidates(classes, least).collect()}
    for x, y in itertools.combinations(sorted(rows, key=lambda r: r.node), 2):
        if (x.category_id, x.bucket) == (y.category_id, y.bucket) and (jac(set(x.words), set(y.words)) >= least or jac(set(x.pieces), set(y.pieces)) >= least):
            assert (x.node, y.node) in found


def test_cosine_and_overlap_lose_no_pair(spark):
    df = listings(spark, 2)
    classes = key_classes(bucketed(df, COMPARED), COMPARED).cache()
    weights = idf(df)
    w = {r.token: r.idf for r in weights.collect()}
    found = {(r.a, r.b): r.cosine for r in cosine_pairs(classes, weights).collect()}
    inside = {(r.a, r.b) for r in shared_words(classes).collect()}
    rows = sorted(classes.collect(), key=lambda r: r.node)
    for x, y in itertools.combinations(rows, 2):
        if (x.category_id, x.bucket) != (y.category_id, y.bucket) or not x.words or not y.words:
            continue
        a, b = set(x.key.split()), set(y.key.split())
        norm = lambda s: sum(w[t] ** 2 for t in s) ** 0.5
        cosine = sum(w[t] ** 2 for t in a & b) / norm(a) / norm(b)
        assert ((x.node, y.node) in found) == (cosine >= 0.7 - 1e-9)
        if len(a & b) / min(len(a), len(b)) >= 0.7:
            assert (x.node, y.node) in inside


def test_labels(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    nodes = sorted({x for p in pairs for x in p} | {999})
    got = {r.node: r.label for r in smallest_label(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(pairs, "a int, b int")).collect()}
    parent = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            m = min(parent[a], parent[b])
            parent[a] = parent[b] = m
    assert got == parent


def test_match_rows_are_disjoint_and_cross_shops(spark):
    df = listings(spark, 4, 160)
    rows = match_rows(df).collect()
    assert len({r.product_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.match_id, []).append(r)
    assert all(len(v) >= 2 and len({r.source_id for r in v}) == len(v) and k == min(r.product_id for r in v) for k, v in by.items())
    taken = df.where(F.col("id") == rows[0].product_id).select(F.col("id").alias("product_id"))
    assert rows[0].product_id not in {r.product_id for r in match_rows(df, taken).collect()}
    assert {tuple(r) for r in match_rows(df).collect()} == {tuple(r) for r in rows}


def test_unknown_content_joins_all_buckets_and_the_larger_cluster_wins(spark):
    rows = [(1, 1, 1, "Ardbeg Ten", 700, True, ""), (2, 2, 1, "Ardbeg Ten", 700, True, ""), (3, 3, 1, "Ardbeg Ten", None, True, ""), (4, 1, 1, "Ardbeg Ten", 1000, True, ""), (5, 2, 1, "Ardbeg Ten", 1000, True, ""), (6, 4, 1, "Ardbeg Ten", 1000, True, "")]
    got = {}
    for r in match_rows(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.match_id, set()).add(r.product_id)
    assert got == {3: {3, 4, 5, 6}}  # four shops before three; the other cluster shares listing 3 and is dropped whole


def test_one_listing_a_shop(spark):
    rows = [(1, 1, 1, "Plavac Mali Reserve", 700, True, ""), (2, 1, 1, "Plavac Mali Reserve Gold", 700, True, ""), (3, 2, 1, "Plavac Mali Reserve", 700, True, ""), (4, 3, 1, "Plavac Mali Reserve", 700, True, "")]
    assert {r.product_id for r in match_rows(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 3, 4}


def test_guards_and_kinds(spark):
    rows = [(1, 1, 1, "Chivas Regal 12", 700, True, ""), (2, 2, 1, "Chivas Regal 18", 700, True, ""), (3, 3, 2, "Moet Imperial", 700, True, ""), (4, 4, 2, "Moet Rose Imperial", 700, True, ""), (5, 1, 3, "Macallan 12 Double Cask", 700, True, ""), (6, 2, 3, "Macallan 12 Triple Cask", 700, True, "")]
    classes = key_classes(bucketed(spark.createDataFrame(rows, SCHEMA)))
    scored = scored_pairs(classes).cache()
    assert edges(scored).count() == 0
    assert edges(scored, digit_guard=False).count() == 1  # by letters the two ages are alike
    kinds = {r.category_id: (r.kind, round(r.best, 3)) for r in pair_classes(scored).collect()}
    assert kinds == {1: ("near_miss", 0.5), 3: ("near_miss", 0.6)}
    assert measured(classes, candidates(classes, 0.37)).where("not same_variant").count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert match_rows(df).count() == 0
    members = bucketed(df)
    classes = key_classes(members, Rules())
    assert disjoint(clusters(members, classes, edges(scored_pairs(classes)))).count() == 0
    assert df.select(match_tokens(normalized_title(F.col("title"))).alias("t")).count() == 0


def test_copies_of_near_misses_are_chained_and_the_most_typical_stays(spark):
    # Class of 1 and 2 near the class of 3: 1 and 3 are of one shop, so the pair is 2 and 3. 4, 5 and 6 chain two listings of shop 1, of which 6 is more like 5; 7 and 8 are copies.
    rows = [(1, 1, 1, "alpha beta gamma"), (2, 2, 1, "alpha beta gamma"), (3, 1, 1, "alpha beta omega"), (4, 1, 2, "alpha beta kappa"), (5, 2, 2, "alpha beta delta sigma"), (6, 1, 2, "alpha delta sigma reserve"), (7, 3, 2, "alpha beta delta sigma"), (8, 3, 2, "alpha beta delta sigma")]
    members = bucketed(spark.createDataFrame([(i, s, c, t, 700, True, "") for i, s, c, t in rows], SCHEMA))
    near = spark.createDataFrame([(1, 700, "alpha beta gamma", "alpha beta omega"), (2, 700, "alpha beta delta sigma", "alpha beta kappa"), (2, 700, "alpha beta delta sigma", "alpha delta sigma reserve")], "category_id int, bucket int, key_a string, key_b string")
    chains = chained(members, near)
    assert {(r.label, r.product_id) for r in chains.collect()} == {(2, 2), (2, 3)} | {(4, i) for i in range(4, 9)}
    assert {tuple(r) for r in typical(chains).collect()} == {(2, 2, 2), (2, 1, 3), (4, 1, 6), (4, 2, 5), (4, 3, 7)}


def test_suggestions_name_shops_of_copies_and_score_every_pair_of_a_group(spark):
    rows = [(1, 1, 1, "alpha beta gamma"), (2, 2, 1, "alpha beta gamma"), (3, 1, 1, "alpha beta omega"), (4, 1, 2, "aa bb cc dd"), (5, 2, 2, "aa bb cc ee ff"), (6, 3, 2, "aa bb cc dd ee ff")]
    got = {}
    for r in suggestions(spark.createDataFrame([(i, s, c, t, 700, True, "") for i, s, c, t in rows], SCHEMA)).collect():
        got.setdefault((r.kind, r.label, round(r.jaccard, 3)), set()).add(r.product_id)
    # 5 and 6 match by words and are no near miss; 4 chains them, and their score is the group's greatest.
    assert got == {("near_miss", 2, 0.5): {2, 3}, ("near_miss", 4, 0.833): {4, 5, 6}}
    assert suggestions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_similarity_and_empty_keys(spark):
    rows = [(1, 1, 1, "alpha beta gamma"), (2, 2, 1, "alpha beta"), (3, 3, 1, ""), (4, 4, 1, None), (5, 5, 1, "omega")]
    df = spark.createDataFrame([(i, s, c, t, 700, True, "") for i, s, c, t in rows], SCHEMA)
    shared = similarity_pairs(df, lambda a, b: F.size(F.array_intersect(a, b)) / F.lit(2.0), 1.0, name="two words")
    assert [tuple(r) for r in shared.collect()] == [("two words", 1, 2)]
    found = {(r.matcher, r.id_a, r.id_b) for r in matcher_pairs(df).collect()}
    assert ("jaccard", 3, 4) in found and ("cosine", 3, 4) not in found
    table = {(r.matcher_a, r.matcher_b): (r.common, r.percent) for r in agreement(matcher_pairs(df)).collect()}
    assert len(table) == 16 and table["cosine", "jaccard"] == (0, 0.0)


def test_stored_normal_form(spark):
    df = spark.createDataFrame([(1, 1, 1, "x", 700, True, "", "ardbeg ten"), (2, 2, 1, "y", 700, True, "", "ardbeg ten"), (3, 3, 1, "z", 700, True, "", None)], SCHEMA + ", normalized_title string")
    assert {r.product_id for r in match_rows(df, rules=Rules(stored=True)).collect()} == {1, 2}
    assert {r.key for r in bucketed(df, Rules(stored=True)).select("key").collect()} == {"ardbeg ten", ""}


def test_chains_of_any_length_and_hubs(spark):
    from stillroom.operators import skew

    before, skew.HEAVY_ROWS, skew.HEAVY_KEYS = (skew.HEAVY_ROWS, skew.HEAVY_KEYS), 20, 1000
    try:
        pairs = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1200)]
        nodes = spark.createDataFrame([(n,) for p in pairs for n in p], "node int")
        got = {r.node: r.label for r in smallest_label(nodes, spark.createDataFrame(pairs, "a int, b int")).collect()}
        assert got == {n: (0 if n < 1000 else 1000) for p in pairs for n in p}
    finally:
        skew.HEAVY_ROWS, skew.HEAVY_KEYS = before


def test_rows_of_a_hot_key_are_not_shuffled(spark):
    from stillroom.operators.skew import join_values

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = join_values(rows, values, "k", 60_000)
    assert got.count() == 60_000 and got.where("k = 7 and low = 0").count() == 20_001  # 0, 3, 6 and so on, and 7 itself
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan
