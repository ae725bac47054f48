"""Bootstrapped differences against a machine that draws block by block."""

import random

import pytest

from moodtide.operators import resampling as R


def machine(x, inside, block, reps):
    n, seed, diffs = len(x), R.SEED, []
    block = min(n, block)
    for _ in range(reps):
        part = total = k = 0
        for filled in range(0, n, block):
            seed = (seed * 1664525 + 1013904223) % 2**32
            start = int(seed / 2**32 * (n - block + 1))
            for i in range(start, start + min(block, n - filled)):
                total += x[i]
                if inside[i]:
                    part, k = part + x[i], k + 1
        if k >= 5:
            diffs.append(part / k - total / n)
    diffs.sort()
    if len(diffs) < reps / 2:
        return None, None, None, len(diffs)
    low, high = (sum(f(d) for d in diffs) / len(diffs) for f in (lambda d: d <= 0, lambda d: d >= 0))
    return diffs[int(len(diffs) * 0.025)], diffs[int(len(diffs) * 0.975)], min(1.0, 2 * min(low, high)), len(diffs)


def test_states_equal_single_steps(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(0, 3000).orderBy("id").select(R.state_after(F.col("id"))).collect()]
    state = R.SEED
    for k, x in enumerate(got):
        assert x == state, k
        state = (state * 1664525 + 1013904223) % 2**32


def test_confidence_equals_a_machine(spark):
    rng = random.Random(2)
    data = {s: [(i, rng.gauss(0, 1), rng.random() < share) for i in range(n)] for s, n, share in (("long", 203, 0.3), ("even", 96, 0.5), ("short", 9, 0.9), ("rare", 120, 0.02), ("one", 1, 1.0), ("empty bucket", 40, 0.0))}
    rows = [(s, i, x, inside) for s, v in data.items() for i, x, inside in v]
    # rows without a value are left out, wherever they stand
    rows += [("long", -1, None, True), ("even", 500, float("nan"), True)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, i int, x double, inside boolean").withColumnRenamed("i", "day")
    got = {r["symbol"]: r for r in R.bucket_confidence(df, ["symbol"], "day", "x", "inside", 80, 7, 1).collect()}
    assert set(got) == set(data)
    for s, v in data.items():
        want = machine([x for _, x, _ in v], [y for _, _, y in v], 8, 80)
        r = got[s]
        assert r["valid"] == want[3] and r["n"] == len(v) and r["bucket"] == sum(y for _, _, y in v)
        assert (r["low"], r["high"], r["p"]) == (None, None, None) if want[0] is None else (r["low"], r["high"], r["p"]) == pytest.approx(want[:3], abs=1e-10)
    assert R.bucket_confidence(df.limit(0), ["symbol"], "day", "x", "inside", 80, 7).count() == 0
