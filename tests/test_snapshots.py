import random

from stillroom.operators.snapshots import changes

SCHEMA = "n int, k int, seen int, a int, b string, change string"


def brute(rows):
    cur = {}
    for n, k, seen, a, b, _ in rows:
        if n is not None and k is not None:
            rank = lambda v: (v is not None, v if v is not None else 0)
            best = cur.get((n, k))
            if best is None or (rank(seen), rank(a), (b is not None, b or "")) > (rank(best[0]), rank(best[1]), (best[2] is not None, best[2] or "")):
                cur[n, k] = (seen, a, b)
    numbers, out = sorted({n for n, *_ in rows if n is not None}), set()
    for before, n in zip(numbers, numbers[1:]):
        old, new = ({k: v[1:] for (m, k), v in cur.items() if m == x} for x in (before, n))
        for k in old.keys() | new.keys():
            if k not in old:
                out.add((k, n, "added"))
            elif k not in new:
                out.add((k, n, "removed"))
            elif old[k] != new[k]:
                out.add((k, n, "changed"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 4, 9, None]), rnd.choice([5] * 5 + [*range(40), None]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1, 2]), rnd.choice([None, "", "x"]), "clash") for _ in range(600)]
    got = changes(spark.createDataFrame(rows, SCHEMA), "n", "k", "seen", ["a", "b"]).collect()
    assert {(r.k, r.n, r.change) for r in got} == brute(rows)
    assert len(got) == len({(r.k, r.n) for r in got})


def test_empty_and_single(spark):
    assert changes(spark.createDataFrame([], SCHEMA), "n", "k", "seen", ["a", "b"]).count() == 0
    assert changes(spark.createDataFrame([(1, 1, 1, 1, "x", "")], SCHEMA), "n", "k", "seen", ["a", "b"]).count() == 0
