"""Rotating portfolios against a machine that rebalances by bisection from day to day, and panels with gaps, nulls and ties."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from moodtide.operators import rotation as R

DAY = dt.date(2020, 1, 1)
ROWS = "panel string, date date, closes array<struct<asset:string,close:double>>, cash double"
TARGETS = "panel string, strategy string, execution date, weights array<double>"


def rebalanced(total, risk, weights, cost):
    low, high = 0.0, total
    for _ in range(200):
        mid = (low + high) / 2
        if mid + cost * sum(abs(w * mid - r) for w, r in zip(weights, risk)) > total:
            high = mid
        else:
            low = mid
    f = (low + high) / 2
    return f, [w * f for w in weights], f - sum(weights) * f, sum(abs(w * f - r) for w, r in zip(weights, risk))


def machine(rows, targets, cost):
    start = min(targets)
    rows = [r for r in rows if r[0] >= start]
    n = len(rows[0][1])
    risk, cash, out = [0.0] * n, 1.0, []
    for t, (day, closes, bills) in enumerate(rows):
        if t:
            risk = [x * c / p for x, c, p in zip(risk, closes, rows[t - 1][1])]
            cash *= bills / rows[t - 1][2]
        total, moved, trades = cash + sum(risk), 0.0, 0
        if day in targets:
            total, risk, cash, moved = rebalanced(total, risk, targets[day], cost)
            trades += moved > 1e-12
        if t == len(rows) - 1:
            total, risk, cash, sold = rebalanced(total, risk, [0.0] * n, cost)
            moved, trades = moved + sold, trades + (sold > 1e-12)
        out.append((day, total, moved, trades))
    return out


def test_wealth_equals_a_machine(spark):
    rng = random.Random(11)
    rows, made = {}, {}
    for panel in "xy":
        level, bills, rows[panel] = [1.0] * 4, 1.0, []
        for i in range(90):
            level = [p * math.exp(rng.gauss(0, 0.03)) for p in level]
            bills *= 1.0002
            rows[panel].append((DAY + dt.timedelta(i), level, bills))
        for s in ("a", "b", "c"):
            days = {3 + rng.randrange(5)} | {rng.randrange(8, 90) for _ in range(12)} | ({89} if s == "b" else set())
            weigh = lambda: rng.choice(([0.0] * 4, [0.25] * 4, [1.0, 0.0, 0.0, 0.0], [rng.random() / 4 for _ in range(4)]))
            made[panel, s] = {DAY + dt.timedelta(i): weigh() for i in days}
    data = spark.createDataFrame([(p, d, list(zip("klmn", c)), b) for p, x in rows.items() for d, c, b in x], ROWS)
    targets = spark.createDataFrame([(p, s, d, w) for (p, s), x in made.items() for d, w in x.items()], TARGETS)
    got = {}
    for r in R.wealth(data, targets, ["panel"], [0.0, 0.02, 0.3]).collect():
        got.setdefault((r["panel"], r["strategy"], r["cost"]), []).append((r["date"], r["wealth"], r["turnover"], r["trades"]))
    assert len(got) == 18
    for (p, s, cost), x in got.items():
        want = machine(rows[p], made[p, s], cost)
        assert [r[0] for r in sorted(x)] == [r[0] for r in want]
        for a, b in zip(sorted(x), want):
            assert a[1] == pytest.approx(b[1], rel=1e-11) and a[2] == pytest.approx(b[2], abs=1e-11) and a[3] == b[3]


def test_kept_solves_its_equation(spark):
    rng = random.Random(5)
    cases = [([0.2] * 5, [0.2] * 5), ([0.0] * 5, [0.0] * 5), ([1.0], [0.0]), ([], [])]
    for _ in range(200):
        n = rng.randrange(1, 12)
        v, w = ([rng.random() * rng.choice((0, 1)) for _ in range(n)] for _ in range(2))
        cases.append(([x / max(1.0, sum(v)) for x in v], [x / max(1.0, sum(w)) for x in w]))
    df = spark.createDataFrame([(v, w, c) for v, w in cases for c in (0.0, 0.002, 0.4)], "v array<double>, w array<double>, c double")
    for r in df.withColumn("f", R.kept(F.col("v"), F.col("w"), F.col("c"))).collect():
        assert abs(r["f"] + r["c"] * sum(abs(w * r["f"] - v) for v, w in zip(r["v"], r["w"])) - 1) < 1e-13


def test_signals_of_gaps_ties_and_leap_days(spark):
    days = [dt.date(2019, 2, 28), dt.date(2019, 3, 21), dt.date(2019, 4, 29), dt.date(2020, 2, 29), dt.date(2020, 3, 29), dt.date(2020, 4, 30), dt.date(2020, 5, 29)]
    close = {"k": [10, 10, 10, 11, 9, 10.5, 1], "l": [10, 10, 10, 11, 9, 12, 1], "m": [10, 10, 10, 10.5, 9, 10.1, 1]}
    bars = spark.createDataFrame([("p", a, d, float(c)) for a, x in close.items() for d, c in zip(days, x)], "panel string, asset string, date date, close double")
    rows = R.common_rows(bars, ["panel"], "asset", 3).withColumn("cash", F.when(F.year("date") == 2019, 1.0).otherwise(1.02))
    got = {r["date"]: r for r in R.momentum_targets(R.anniversaries(rows, ["panel"])).collect()}
    # eight days before the anniversary is too old, and nothing follows the last row
    assert sorted(got) == [dt.date(2020, 2, 29), dt.date(2020, 4, 30)]
    leap, april = got[days[3]], got[days[5]]
    assert leap["reference"] == days[0] and leap["execution"] == days[4]
    # a tie goes to the first name
    assert leap["top1"] == [1.0, 0.0, 0.0] and leap["top2"] == [0.5, 0.5, 0.0]
    assert april["reference"] == days[2] and april["top1"] == [0.0, 1.0, 0.0] and april["top2"] == [0.5, 0.5, 0.0]
    poor = R.momentum_targets(R.anniversaries(rows.withColumn("cash", F.when(F.year("date") == 2019, 1.0).otherwise(1.08)), ["panel"])).filter("month(date) = 4").first()
    assert poor["top1"] == [0.0, 1.0, 0.0] and poor["top2"] == [0.0, 0.5, 0.0]


def test_common_rows_leave_out_gaps_nulls_and_repeated_assets(spark):
    bars = spark.createDataFrame(
        [("p", a, dt.date(2020, 1, d), c) for d, x in enumerate(([("k", 1.0), ("l", 2.0)], [("k", 1.0)], [("k", 1.0), ("l", None)], [("k", 1.0), ("l", float("nan"))], [("k", 1.0), ("k", 2.0)], [("l", 3.0), ("k", 1.0)], [("k", 0.0), ("l", 1.0)]), 1) for a, c in x],
        "panel string, asset string, date date, close double",
    )
    got = R.common_rows(bars, ["panel"], "asset", 2).orderBy("date").collect()
    assert [r["date"].day for r in got] == [1, 6] and [x["asset"] for x in got[1]["closes"]] == ["k", "l"]
    none = R.common_rows(bars.limit(0), ["panel"], "asset", 2).withColumn("cash", F.lit(1.0))
    assert R.momentum_targets(R.anniversaries(none, ["panel"])).count() == 0
    assert R.summary(R.wealth(none, spark.createDataFrame([], TARGETS), ["panel"], [0.1]), ["panel", "strategy", "cost"]).count() == 0
