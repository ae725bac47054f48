"""Replayed decisions against a machine that steps from bar to bar, and ledgers that are wrong, empty or hold nulls."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from moodtide.operators import replay as L

BARS = "symbol string, index int, date date, close double"
DECISIONS = "symbol string, index int, date date, execution int, ordinal int, target string, action string"
DAY = dt.date(2020, 1, 1)


def bars_of(spark, closes):
    return spark.createDataFrame([(s, i, DAY + dt.timedelta(i), float(c)) for s, x in closes.items() for i, c in enumerate(x)], BARS)


def machine(closes, decisions, cost):
    """decisions: (index, execution or None, target)."""
    first, last = decisions[0][0], decisions[-1][0]
    fills = {e: t for _, e, t in decisions if e is not None}
    wealth = peak = 1.0
    held, worst, n_fills, inside, net = "LONG", 0.0, 0, 0, []
    for i in range(first + 1, last + 1):
        before = wealth
        if held == "LONG":
            wealth *= closes[i] / closes[i - 1]
            inside += 1
        if i in fills and fills[i] != held:
            wealth *= 1 - cost
            n_fills += 1
            held = fills[i]
        net.append(wealth / before - 1)
        peak = max(peak, wealth)
        worst = max(worst, 1 - wealth / peak)
    return wealth, worst, n_fills, inside / max(1, last - first), statistics.stdev(net) * math.sqrt(252)


def test_replay_equals_a_machine(spark):
    rng = random.Random(3)
    closes = {s: [math.exp(sum(rng.gauss(0, 0.02) for _ in range(3)) + 3) for _ in range(120)] for s in "abcd"}
    made = {}
    for s in closes:
        # some are never carried out, some two at the same bar
        made[s] = [(i, rng.choice((None, i + 1, i + 1, i + 2)), rng.choice(("LONG", "CASH"))) for i in range(5 + rng.randrange(9), 110)]
    rows = [(s, i, DAY, e, k, t, "x") for s, x in made.items() for k, (i, e, t) in enumerate(x)]
    rng.shuffle(rows)
    bars, decisions = bars_of(spark, closes), spark.createDataFrame(rows, DECISIONS)
    done = L.figures(L.path(decisions, bars, ["symbol"], [0.0, 0.01]), decisions, ["symbol"]).collect()
    assert len(done) == 8
    for r in done:
        wealth, worst, fills, inside, vol = machine(closes[r["symbol"]], made[r["symbol"]], r["cost"])
        assert r["wealth"] == pytest.approx(wealth, rel=1e-11) and r["drawdown"] == pytest.approx(worst, abs=1e-11)
        assert (r["fills"], r["exposure"]) == (fills, pytest.approx(inside)) and r["volatility"] == pytest.approx(vol, rel=1e-9)
        assert r["cost_multiplier"] == pytest.approx((1 - r["cost"]) ** fills)
    assert all(len({r["ledger"] for r in done if r["symbol"] == s}) == 1 for s in closes) and len({r["ledger"] for r in done}) == 4


def test_timeline_of_sound_wrong_and_empty_ledgers(spark):
    bars = bars_of(spark, {"a": [1] * 12, "b": [1] * 12})
    targets = bars.filter("index between 2 and 10").withColumn("target", F.when(F.col("index") % 3 == 0, "CASH").otherwise("LONG"))
    sound = L.ledger(targets, ["symbol"])
    assert L.timeline_problems(sound, bars, ["symbol"]).count() == 0
    assert L.timeline_problems(sound.limit(0), bars, ["symbol"]).count() == 0
    # a target that isn't one of the two: itself, and what the next one finds
    odd = sound.withColumn("target", F.when((F.col("symbol") == "a") & (F.col("index") == 4), "HALF").when((F.col("symbol") == "b") & (F.col("index") == 4), None).otherwise(F.col("target")))
    found = {}
    for r in L.timeline_problems(odd, bars, ["symbol"]).collect():
        found.setdefault((r["symbol"], r["place"]), set()).add(r["problem"])
    assert found == {("a", 2): {"target", "action", "digest"}, ("a", 3): {"filled", "traded"}, ("b", 2): {"target", "action", "digest"}, ("b", 3): {"filled", "traded"}}
    # a decision on a bar that isn't there, and one given twice
    gone = L.timeline_problems(sound, bars.filter("index <> 7"), ["symbol"]).collect()
    assert {(r["place"], r["problem"]) for r in gone} == {(5, "date")}
    twice = {r["problem"] for r in L.timeline_problems(sound.unionByName(sound.filter("index = 10")), bars, ["symbol"]).collect()}
    assert {"gap", "ordinal"} <= twice
    void = sound.select("symbol", "index", *[F.lit(None).cast(t).alias(c) for c, t in sound.dtypes if c not in ("symbol", "index")])
    assert {r["problem"] for r in L.timeline_problems(void.filter("index = 2"), bars, ["symbol"]).collect()} == {"ordinal", "date", "execution", "target", "action", "filled", "traded", "digest"}


def test_one_decision_and_none(spark):
    bars = bars_of(spark, {"a": [1, 2, 3]})
    one = spark.createDataFrame([("a", 1, DAY, 2, 0, "CASH", "SELL")], DECISIONS)
    r = L.figures(L.path(one, bars, ["symbol"], [0.1]), one, ["symbol"]).first()
    assert (r["intervals"], r["wealth"], r["exposure"], r["fills"], r["volatility"], r["cash"]) == (0, 1.0, 1.0, 0, 0.0, 1)
    assert L.path(one.limit(0), bars, ["symbol"], [0.1]).count() == 0


def test_differences_by_tolerance_nulls_and_lost_rows(spark):
    a = spark.createDataFrame([("a", 1.0, 1e9), ("b", None, 2.0), ("c", float("nan"), 1.0)], "k string, x double, y double")
    b = spark.createDataFrame([("a", 1.0 + 5e-10, 1e9 + 0.5), ("b", None, 2.1), ("c", float("nan"), None), ("d", 0.0, None)], "k string, x double, y double")
    got = {(r["k"], r["field"]): (r["reported"], r["recomputed"]) for r in L.differences(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {("b", "y"): (2.0, 2.1), ("c", "y"): (1.0, None), ("d", "x"): (None, 0.0)}
    nan = L.differences(a.filter("k = 'c'"), b.filter("k = 'a'").withColumn("k", F.lit("c")), ["k"], ["x"]).collect()
    assert len(nan) == 1


def test_scoreability_of_void_attestations(spark):
    rows = spark.sql(f"select from_json(t, '{L.ATTESTATION}') as a, l from values ('{{}}', array('x')), (null, null), ('{{\"risky\": null, \"frozen\": true}}', array(cast(null as string))) v(t, l)")
    got = [r[0] for r in rows.select(L.scoreability(F.col("a"), F.col("l"))).collect()]
    assert len(got[0]) == 8 and "MISSING_SCOREABILITY_ATTESTATION" not in got[0]
    assert got[1] == ["MISSING_SCOREABILITY_ATTESTATION"]
    assert len(got[2]) == 7 and all(x == sorted(x) for x in got)
