import datetime
import random
from decimal import Decimal

import numpy as np
import pytest

from stillroom.operators.history import run_starts, versions

SCHEMA = "product_id int, at timestamp, price decimal(10,2), ok boolean, entity string"
T0 = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)


def at(us):
    return T0 + datetime.timedelta(microseconds=us)


def brute(rows):
    out, by = set(), {}
    for p, t, price, ok, _ in rows:
        if p is not None and t is not None:
            by.setdefault(p, {})[t] = (price, ok)
    for p, states in by.items():
        runs = []
        for t in sorted(states):
            if runs and runs[-1][1] == states[t]:
                runs[-1][2], runs[-1][3] = t, runs[-1][3] + 1
            else:
                runs.append([t, states[t], t, 1])
        for i, (t, state, last, n) in enumerate(runs):
            out.add((p, t, runs[i + 1][0] if i + 1 < len(runs) else None, last, n, *state))
    return out


def test_run_starts_is_every_border():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 100, 257):
        e, p = np.sort(rnd.integers(0, 4, n)), rnd.integers(0, 2, n)
        expected = [i == 0 or e[i] != e[i - 1] or p[i] != p[i - 1] for i in range(n)]
        assert run_starts(e, p).tolist() == expected


@pytest.mark.parametrize("slices", [1, 2, 5, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_entity(spark, slices, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        p = rnd.choice([7] * 6 + [1, 2, 3, None])
        t = None if rnd.random() < 0.03 else at(rnd.randrange(2_000))
        rows.append((p, t, None, None, None))
    state = {}
    filled = []
    for p, t, *_ in rows:  # rows of one entity and time agree; long stretches of one state cross the slices
        key = (p, t)
        if key not in state:
            long = p == 7 and t is not None and (t - T0).microseconds < 1_500
            state[key] = (Decimal("5.00"), True) if long else (rnd.choice([None, Decimal("1.00"), Decimal("2.00")]), rnd.choice([None, True, False]))
        filled.append((p, t, *state[key], "clash"))
    df = spark.createDataFrame(filled, SCHEMA)
    got = {(r.product_id, r.valid_from_us, r.valid_to_us, r.last_seen_us, r.n_updates, r.price, r.ok) for r in versions(df, "product_id", "at", ["price", "ok"], slices).collect()}
    micros = lambda t: None if t is None else int((t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(microseconds=1))
    assert got == {(p, micros(a), micros(b), micros(c), n, price, ok) for p, a, b, c, n, price, ok in brute(filled)}


def test_empty_and_disagreeing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert versions(df, "product_id", "at", ["price", "ok"], 4).count() == 0
    two = spark.createDataFrame([(1, at(5), Decimal("1.00"), True, ""), (1, at(5), Decimal("3.00"), True, "")], SCHEMA)
    assert [r.price for r in versions(two, "product_id", "at", ["price", "ok"], 4).collect()] == [Decimal("3.00")]


def test_previous_values_across_slots(spark):
    import random

    from pyspark.sql import functions as F

    from stillroom.operators.history import previous_values

    rnd = random.Random(1)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, 1.0, 2.0]), rnd.randrange(60), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, product_id int, price double, at int, k string")
    got = {r.id: r.before for r in previous_values(df, "product_id", ["at", "id"], "price", F.floor(F.col("at") / 7)).collect()}
    last, expected = {}, {}
    for i, p, price, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if p is not None:
            expected[i] = last.get(p)
            last[p] = price
    assert got == expected
