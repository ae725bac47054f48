"""Rules by composed transition maps against machines that step through each series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from moodtide.operators import grid as G, positions as P, scan

DAY = dt.date(2020, 1, 1)


def series_of(draw, lengths):
    return [(f"s{k}", DAY + dt.timedelta(days=i + draw.choice([0, 0, 100]) * (i > 20)), draw.randrange(6)) for k, n in enumerate(lengths) for i in range(n)]


@pytest.mark.parametrize("k", [2, 4, 17])  # 17 states don't fit the bits of a long
def test_maps_equal_a_machine(spark, k):
    draw = random.Random(k)
    tables = [[draw.randrange(k) for _ in range(k)] for _ in range(5)] + [None]
    rows = [(f"s{j}", i, draw.randrange(6)) for j, n in enumerate((1, 2, 63, 64, 65)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, i int, t int")
    after = [F.coalesce(*(F.when(F.col("t") == t, F.lit(m[s] if m else s)) for t, m in enumerate(tables))) for s in range(k)]
    got = {(r.symbol, r.i): (r.before, r.after) for r in scan.states(df, ["symbol"], after, 1, "i").collect()}
    now: dict = {}
    for s, i, t in sorted(rows):
        before = now.get(s, 1)
        now[s] = tables[t][before] if tables[t] else before
        assert got[s, i] == (before, now[s])
    assert scan.states(df.limit(0), ["symbol"], after, 1, "i").collect() == []


def scored(draw, spark, n=160):
    rows = []
    for s in ("a", "b"):
        date = DAY
        for i in range(n):
            date += dt.timedelta(days=draw.choice([1, 1, 1, 60]))
            rows.append((s, date, draw.choice([None, float(draw.randrange(0, 101)), 20.04, 24.96, 75.0]), draw.choice([True, False, None]), 1.0))
    return rows, spark.createDataFrame(rows, "symbol string, date date, score double, trend_up boolean, close double")


def shown(s):
    return None if s is None else int(int(s * 10 + 0.5) / 10 + 0.5)


def test_armed_trend_equals_a_machine(spark):
    rows, df = scored(random.Random(2), spark)
    got = {(r.symbol, r.date): r.position for r in P.armed_trend(df, ["symbol"], 25, 75, 90).collect()}
    for s in ("a", "b"):
        position, armed = 1.0, None
        for _, date, score, up, _ in (r for r in rows if r[0] == s):
            assert got[s, date] == position
            v = shown(score)
            armed = date if v is not None and v <= 25 else armed
            if v is not None and v >= 75:
                position, armed = 0.0, None
            elif armed and (date - armed).days > 90:
                armed = None
            elif armed and up and not position:
                position, armed = 1.0, None


def test_fear_then_time_equals_a_machine(spark):
    rows, df = scored(random.Random(3), spark)
    got = {(r.symbol, r.date): r.position for r in P.fear_then_time(df, ["symbol"], 25, 21).collect()}
    for s in ("a", "b"):
        left = 0
        for _, date, score, _, _ in (r for r in rows if r[0] == s):
            assert got[s, date] == float(left > 0)
            v = shown(score)
            left = left - 1 if left else 21 if v is not None and v <= 25 else 0


def plain_path(bars, enter, leave, cost, start):
    """Wealth, trades, exposure, pending of one rule; bars: (close, features)."""
    position, wealth, trades, inside = start, 1.0, 0, 0
    target = lambda f, p: p if enter(f) is None else (1 if enter(f) else 0) if leave is None else (0 if p and leave(f) else 1 if not p and enter(f) else p)
    for (close, f), (later, _) in zip(bars, bars[1:]):
        inside += position
        wealth *= later / close if position else 1
        to = target(f, position)
        if to != position:
            wealth, trades, position = wealth * (1 - cost), trades + 1, to
    return wealth, trades, inside / (len(bars) - 1), int(target(bars[-1][1], position) != position)


def test_grid_equals_one_rule_at_a_time(spark):
    draw = random.Random(9)
    at = {f: i for i, f in enumerate(G.FEATURES)}
    data = []
    for s, n in (("a", 40), ("b", 71)):
        close = 100.0
        for i in range(n):
            close *= 1 + draw.uniform(-0.05, 0.05)
            features = [draw.uniform(0, 100) for _ in G.FEATURES]
            features[at["shown"]], features[at["votes"]] = float(draw.randrange(30, 80)), float(draw.randrange(7))
            features[at["above_125"]], features[at["above_210"]] = float(draw.random() < 0.5), float(draw.random() < 0.5)
            if draw.random() < 0.1:
                features[at["mean_63"]] = None
            data.append((s, DAY + dt.timedelta(days=i), close, i, n, features))
    bars = spark.createDataFrame(data, "symbol string, date date, close double, i int, n int, features array<double>")
    rules = G.rule_table(spark)
    assert rules.count() == 47 and rules.filter("family <> 'control'").count() == 45 and rules.select("rule").distinct().count() == 47
    done = G.results(G.paths(G.stages(bars).crossJoin(F.broadcast(rules)), ["symbol"]), ["symbol"], {"base": 0.01}).collect()
    got = {(r.symbol, r.stage, r.rule): r for r in done}
    compare = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}

    def check(p):
        feature, op, other, constant, gate, how = p

        def holds(f):
            x, y = f[feature], f[other] if other is not None else constant
            c = None if x is None or y is None else compare[op](x, y)
            return c if how is None or c is None else (c and f[gate] > 0) if how == "and" else (c or f[gate] > 0)

        return holds

    for s, n in (("a", 40), ("b", 71)):
        mine = [(r[2], r[5]) for r in data if r[0] == s]
        cut = -(-n * 6 // 10)
        for stage, part in (("development", mine[:cut]), ("holdout", mine[cut - 1 :])):
            for rule, _, enter, leave in G.rule_list():
                wealth, trades, inside, pending = plain_path(part, check(enter), check(leave) if leave else None, 0.01, 1)
                r = got[s, stage, rule]
                assert (r.trades, r.pending) == (trades, pending) and abs(r.wealth - wealth) < 1e-9 and abs(r.exposure - inside) < 1e-12
                assert abs(r.ratio - wealth / (part[-1][0] / part[0][0])) < 1e-9


def test_shifted_sentiment_keeps_gates(spark):
    width = len(G.FEATURES)
    data = [("a", DAY + dt.timedelta(days=i), 1.0, i, 5, [float(10 * i + k) for k in range(width)]) for i in range(5)]
    bars = spark.createDataFrame(data, "symbol string, date date, close double, i int, n int, features array<double>")
    gates = [k for k, f in enumerate(G.FEATURES) if f.startswith("above_")]
    moved = G.shifted(bars, ["symbol"], F.array(F.lit(2))).collect()
    assert len(moved) == 5
    for r in moved:
        assert r.features == [float(10 * (r.i if k in gates else (r.i - 2) % 5) + k) for k in range(width)]


def test_one_rule_for_all_series(spark):
    rows = []
    for s in ("a", "b"):
        for place, (rule, base, stress) in enumerate((("x", 1.2, 1.1), ("y", 1.3 if s == "a" else 1.1, 1.05), ("z", 2.0, 0.9 if s == "b" else 1.5), ("w", 1.2, 1.1))):
            rows += [(s, "development", rule, "level", place, sc, r, 6, 0.5) for sc, r in (("base", base), ("stress", stress))]
    done = spark.createDataFrame(rows, "symbol string, stage string, rule string, family string, place int, scenario string, ratio double, trades int, exposure double")
    assert [(r.rule, round(r.objective, 9)) for r in G.shared_selection(done, ["symbol"]).collect()] == [("x", 0.182321557)]
    best = {r.symbol: (r.rule, r.eligible) for r in G.selection(done, ["symbol"], 1).collect()}
    assert best == {"a": ("z", 4), "b": ("w", 3)}
    none = G.selection(done.withColumn("ratio", F.lit(0.5)), ["symbol"]).collect()
    assert sorted((r.symbol, r["rank"], r.rule) for r in none) == [("a", 0, None), ("b", 0, None)] and G.shared_selection(done.withColumn("ratio", F.lit(0.5)), ["symbol"]).count() == 0
