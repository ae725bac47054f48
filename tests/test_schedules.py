"""Scheduled exposures against a ledger stepped through day by day; cash against daily products."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from moodtide.operators import schedules as H

DAY = dt.date(2020, 1, 1)


def ledger(rows, cost, spread):
    """Log growth between closes; rows: (date, close, cash, target)."""
    risky, idle, wealth, out = 0.0, 1.0, 1.0, []

    def trade(x):
        nonlocal risky, idle, wealth
        w = risky + idle
        post = (w + cost * risky) / (1 + cost * x) if x * w > risky else (w - cost * risky) / (1 - cost * x)
        risky, idle, wealth = x * post, post - x * post, post

    trade(rows[0][3])
    before = wealth
    for (d0, p0, c0, _), (d1, p1, c1, x) in zip(rows, rows[1:]):
        risky *= p1 / p0
        idle *= c1 / c0 * (math.exp(spread * (d1 - d0).days / 365.2425) if idle < 0 else 1)
        wealth = risky + idle
        if x is not None:
            trade(x)
        if d1 == rows[-1][0]:
            trade(0.0)
        out.append(math.log(wealth / before))
        before = wealth
    return out


def test_path_equals_a_ledger(spark):
    draw = random.Random(5)
    data, expected = [], {}
    for s in ("a", "b", "c"):
        price, cash, date, rows = 100.0, 1.0, DAY, []
        for i in range(60):
            date += dt.timedelta(days=draw.choice([1, 1, 3, 40]))
            price, cash = price * math.exp(draw.gauss(0, 0.02)), cash * 1.0002
            rows.append((date, price, cash, draw.choice([0.0, 0.5, 1.0, 1.4, 1.5]) if i == 0 or draw.random() < 0.2 else None))
        if s == "c":
            rows[-1] = (*rows[-1][:3], 1.2)  # a trade on the last day, then all is sold
        expected[s] = ledger(rows, 0.004, 0.03)
        data += [(s, *r) for r in rows]
    df = spark.createDataFrame(data, "symbol string, date date, close double, cash double, target double")
    got = {}
    for r in H.path(df, ["symbol"], 0.004, 0.03).orderBy("symbol", "date").collect():
        if r.g is not None:
            got.setdefault(r.symbol, []).append(r.g)
        assert r.solvent
    for s in expected:
        assert len(got[s]) == 59 and max(abs(a - b) for a, b in zip(got[s], expected[s])) < 1e-12
    ruin = spark.createDataFrame([("a", DAY, 100.0, 1.0, 1.5), ("a", DAY + dt.timedelta(1), 30.0, 1.0, None), ("a", DAY + dt.timedelta(2), 200.0, 1.0, None)], df.schema)
    assert [r.solvent for r in H.path(ruin, ["symbol"], 0.0, 0.0).orderBy("date").collect()] == [True, False, False]
    assert H.volatility(H.path(ruin, ["symbol"], 0.0, 0.0), ["symbol"]).count() == 0


def test_schedules_with_the_same_days_share_their_simulations(spark):
    draw = random.Random(8)
    days = [DAY + dt.timedelta(days=i) for i in range(120)]
    price, bars = 1.0, []
    for d in days:
        price *= math.exp(draw.gauss(0, 0.01))
        bars.append(("a", d, price, 1.0))
    bars = spark.createDataFrame(bars, "symbol string, date date, close double, cash double")
    plans = {"p": ({0: 0.5, 30: 1.0, 60: 0.7}), "q": ({0: 1.0, 30: 0.2, 60: 1.3}), "r": ({0: 0.5, 31: 1.0})}
    events = spark.createDataFrame([("a", k, days[i], x) for k, p in plans.items() for i, x in p.items()], "symbol string, plan string, date date, target double")
    grid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: k * 0.1)
    got = {r.plan: r for r in H.matched_controls(events, bars, ["symbol", "plan"], ["symbol"], grid, 0.001, 0.01).collect()}
    assert [got[k].sharing for k in "pqr"] == [2, 2, 1] and {r.simulations for r in got.values()} == {16}
    tried = events.select("plan", "date").join(bars.select("symbol").distinct()).withColumn("x", F.explode(grid))
    for k, p in plans.items():  # the plain product of schedules and grid
        one = tried.filter(F.col("plan") == k)
        rows = bars.withColumn("x", F.explode(grid)).join(one.select("x", "date", F.col("x").alias("target")), ["x", "date"], "left")
        vol = {r.x: r.volatility for r in H.volatility(H.path(rows, ["x"], 0.001, 0.01), ["x"]).collect()}
        best = min(vol, key=lambda x: (round(abs(vol[x] - got[k].own), 10), x))
        assert (got[k].target, round(got[k].control, 12)) == (best, round(vol[best], 12))


def test_segments_equal_daily_products(spark):
    draw = random.Random(4)
    dates = sorted(draw.sample(range(0, 300), 60))
    seen = sorted(draw.sample(range(-5, 200), 90))
    rates = {d: draw.uniform(0, 6) for d in seen}
    at = lambda d: DAY + dt.timedelta(days=d)
    calendar = spark.createDataFrame([("a", at(d)) for d in dates], "k string, date date")
    quotes = spark.createDataFrame([("a", at(d), p) for d, p in rates.items()] + [("a", at(250), None)], "k string, date date, p double")
    got = {(r.date - DAY).days: r for r in H.segmented_cash(calendar, quotes, ["k"], "p", 7).collect()}
    log, bad = 0.0, None
    for d in range(dates[0], dates[-1] + 1):
        if d in dates:
            assert (got[d].refused is None) == (bad is None or bad > d)
            if bad is None:
                assert abs(got[d].wealth - math.exp(log)) < 1e-12
            else:
                assert got[d].wealth is None and (got[d].refused - DAY).days == bad
        last = max((x for x in seen if x <= d), default=None)
        if bad is None and (last is None or d + 1 - last > 7):
            bad = d + 1
        elif bad is None:
            log += math.log(1 / (1 - rates[last] / 100 * 91 / 360)) / 91
    assert bad is not None
