import numpy as np
import pytest

from stillroom.llm.mixing import apportioned, drawn_slots, mix, packed, permuted, split


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    seen = permuted(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(seen) == list(range(n))
    if n > 100:
        assert (seen != permuted(np.arange(n), np.full(n, n), np.full(n, 100))).mean() > 0.9


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "a", "one two three four five " * (i % 7 + 1), "x") for i in range(400)] + [(1000 + i, "b", "alpha beta gamma delta " * 6, "x") for i in range(40)] + [(2000, "c", None, "x"), (2001, "c", "", "x"), (2002, None, "text", "x"), (2003, "z", "unwanted words", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string")


def test_mix(spark, corpus):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.05, 2), ("d", 0.05, 2)], "source string, target_share double, max_repeats int")
    made = mix(corpus, targets, block_tokens=8)
    rows, shares = made.chosen.collect(), {r.source: r for r in made.reached().collect()}
    assert len(rows) == len({r.doc_id for r in rows})
    caps = {"a": 1, "b": 3}
    assert all(r.repeats <= caps[r.source] and 0 < r.used_tokens <= r.n_tokens * r.repeats for r in rows)
    assert abs(shares["a"].reached_share - 0.6 / 0.9) < 0.01 and abs(shares["b"].reached_share - 0.3 / 0.9) < 0.01
    assert shares["c"].used_tokens == shares["d"].used_tokens == 0
    assert shares["b"].max_used > 1  # the scarce source is repeated
    assert sum(r.used_tokens for r in rows) == sum(s.used_tokens for s in shares.values())
    again = mix(corpus, targets, block_tokens=8).chosen
    assert {(r.doc_id, r.repeats) for r in again.collect()} == {(r.doc_id, r.repeats) for r in rows}


def test_too_large_a_mix_uses_everything_as_often_as_it_may(spark, corpus):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    for r in mix(corpus, targets, total_tokens=40_000, block_tokens=8).reached().collect():
        assert r.max_used == r.max_repeats and r.used_tokens == r.available_tokens * r.max_repeats


def test_apportioned():
    assert apportioned([0.5, 0.3, 0.2], [99] * 3, 7) == [4, 2, 1] and apportioned([0.5, 0.5], [1, 99], 10) == [1, 5] and apportioned([], [], 5) == []


@pytest.mark.parametrize("counts", [[5, 0, 3], [1000, 10, 1], [3_000_000_000, 10**12, 7]])
def test_split_is_a_draw_without_replacement(counts):
    draw = np.random.default_rng(1)
    for size in (0, 1, sum(counts) // 2, sum(counts)):
        got = split(counts, size, draw)
        assert sum(got) == size and all(0 <= g <= n for g, n in zip(got, counts, strict=True))
    half = [split(counts, sum(counts) // 2, draw)[0] / max(1, counts[0]) for _ in range(200)]
    assert abs(np.mean(half) - 0.5) < 0.1


def test_shards_number_each_source_through(spark):
    counts = [700, 41, 0, 259]
    rows = sorted(drawn_slots(spark, counts, 16, 7).collect())
    for k, n in enumerate(counts):
        own = [r for r in rows if r.s == k]
        assert [r.first for r in own] == [sum(x.n for x in own[:i]) for i in range(len(own))] and sum(r.n for r in own) == n
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n
    assert list(sizes.values()) == [16] * 62 + [8]
    assert len({r.n for r in rows if r.s == 0}) > 3  # shards differ


def test_packing_is_gapless(spark, corpus):
    from stillroom.llm.mixing import token_counts

    for size in (20_000, 30):
        ends = {}
        for r in sorted(packed(token_counts(corpus).where("n_tokens > 0 and source is not null"), size).collect(), key=lambda r: (r.source, r.start)):
            assert r.start == ends.get(r.source, 0)
            ends[r.source] = r.start + r.n_tokens


def test_empty(spark, corpus):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    made = mix(corpus.limit(0), targets)
    assert made.chosen.count() == 0 and [r.used_tokens for r in made.reached().collect()] == [0]
    made = mix(corpus, targets.limit(0))
    assert made.chosen.count() == 0 and made.reached().count() == 0
