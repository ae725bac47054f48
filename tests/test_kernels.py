"""Rules that SQL can't state, against plain loops; and fixed values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from moodtide.functions import numbers as N, texts
from moodtide.operators import calendars as C, models as M, observations as B, policies as K, positions as P, stats as T, studies as D, windows as W
from moodtide.sources import filings as R


def series(spark, values, name="raw"):
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_midranks(spark):
    s = series(spark, [1.0, 2.0, 3.0, 1000.0])
    assert [round(x, 1) for x in column(W.trailing_midrank(s, ["symbol"], 3, 1), "score")] == [50, 75, 83.3, 83.3]
    assert [round(x, 1) for x in column(W.expanding_midrank(s, ["symbol"], 1), "score")] == [50, 75, 83.3, 87.5]


def test_midrank_of_a_prefix_is_the_prefix_of_the_midrank(spark):
    rng = np.random.default_rng(1)
    values = [float(v) if v > 1 else None for v in rng.integers(0, 20, 200)]
    whole = column(W.expanding_midrank(series(spark, values), ["symbol"], 10), "score")
    assert column(W.expanding_midrank(series(spark, values[:90]), ["symbol"], 10), "score") == whole[:90]


def test_rounding_and_bands(spark):
    df = spark.createDataFrame([(-0.25,), (24.94,), (24.95,), (74.45,), (74.95,), (None,)], "x double")
    rows = df.select(N.half_up(F.col("x"), 1).alias("r"), N.displayed(F.col("x")).alias("d"), N.label(F.col("x")).alias("l")).collect()
    assert [r.r for r in rows][:4] == [-0.2, 24.9, 25.0, 74.5]
    assert rows[3].d == 75 and rows[1].l == "Extreme Fear" and rows[2].l == "Fear" and rows[4].l == "Extreme Greed" and rows[5].l is None


def test_normal_cdf(spark):
    got = spark.range(-30, 31).select((F.col("id") / 10).alias("z"), N.normal_cdf(F.col("id") / 10).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 2e-7 for r in got)


def test_easter(spark):
    got = C.easter_days(spark, 1900, 2099).collect()
    assert len(got) == 200 and all(r.easter == easter(r.year) for r in got)


def test_chains_of_any_length_are_maximal(spark):
    from moodtide.operators import holdings as H

    links = [(f"a{i}", f"a{i + 1}", 1.01) for i in range(500)] + [("x", "y", 2.0), ("p", "q", 3.0), ("q", "r", 0.5)]
    got = {(r["first"], r["last"], r.length): r["product"] for r in H.chains(spark.createDataFrame(links, "s string, e string, v double"), "s", "e", "v").collect()}
    assert set(got) == {("a0", "a500", 500), ("x", "y", 1), ("p", "r", 2)}
    assert abs(got[("p", "r", 2)] - 1.5) < 1e-9 and abs(got[("a0", "a500", 500)] / 1.01**500 - 1) < 1e-9


def test_numbers_in_texts(spark):
    df = spark.createDataFrame([("$1,234.50",), ("(12)",), ("12a",), ("5%",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(texts.strict_number(F.col("x"), negative=True)).collect()] == [1234.5, -12.0, None, 5.0, None, None]
    assert df.limit(1).select(texts.turkish_number(F.lit("360.090.525,84"))).first()[0] == 360090525.84
    assert df.limit(1).select(texts.issuer_key(F.lit("Topicus.com Inc"))).first()[0] == "TOPICUS COM"


def test_fear_then_time_and_continuous(spark):
    rng = np.random.default_rng(2)
    scores = rng.uniform(0, 100, 300)
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, None if i % 17 == 0 else float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, score double")
    want, i = [0.0] * 300, 0
    shown = [None if r[3] is None else math.floor(math.floor(r[3] * 10 + 0.5) / 10 + 0.5) for r in rows]
    while i < 299:
        if shown[i] is not None and shown[i] <= 10:
            for k in range(i + 1, min(i + 7, 299) + 1):
                want[k] = 1.0
            i += 8
        else:
            i += 1
    assert column(P.fear_then_time(df, ["symbol"], 10, 7), "position") == want
    now, want = 1.0, [1.0]
    for r in rows[:-1]:
        if r[3] is not None and abs((100 - r[3]) / 100 - now) > 0.1:
            now = (100 - r[3]) / 100
        want.append(now)
    assert column(P.continuous(df, ["symbol"], True), "position") == pytest.approx(want)


def test_hysteresis_is_the_state_machine(spark):
    rng = np.random.default_rng(3)
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, float(s)) for i, s in enumerate(rng.uniform(0, 100, 400))]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, score double")
    state, want = 1, [1]
    for i, r in enumerate(rows[:-1]):
        s = math.floor(math.floor(r[3] * 10 + 0.5) / 10 + 0.5)
        if i % 3 == 0:
            state = 0 if state == 1 and s >= 70 else 1 if state == 0 and s <= 30 else state
        want.append(state)
    assert column(P.hysteresis(df, ["symbol"], 30, 70, 1, 3), "position") == want


def test_holm_and_benjamini_hochberg(spark):
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.5])], "family string, k int, p double")
    rows = T.holm(T.benjamini_hochberg(tests, "p", ["family"], ["k"]), "p", ["family"], ["k"]).orderBy("k").collect()
    assert [round(r.q, 4) for r in rows] == [0.05, 0.05, 0.05, 0.05, 0.5]
    assert [round(r.holm_p, 4) for r in rows] == [0.05, 0.08, 0.09, 0.09, 0.5]
    assert [r.holm_rejected for r in rows] == [True, False, False, False, False]


def test_generator_jumps_equal_steps():
    x, want = 20260825, []
    for _ in range(100):
        x = (1664525 * x + 1013904223) % 2**32
        want.append(x / 2**32)
    assert M.lcg(20260825, 100).tolist() == want


def test_rebalancing_closed_form_equals_bisection(spark):
    for wealth, risk, target in ((1.0, 0.2, 0.7), (2.0, 1.9, 0.5), (1.0, 0.5, 0.5)):
        got = spark.range(1).select(N.rebalanced_risk(F.lit(wealth), F.lit(risk), F.lit(target), 0.005)).first()[0]
        left = M.multi_rebalanced(wealth, np.array([risk]), np.array([target]), 0.005)
        assert got == pytest.approx(target * left, abs=1e-9)


def test_online_ridge_equals_refitting(spark):
    rng = np.random.default_rng(4)
    n = 60
    x = rng.normal(size=(n, 2))
    y = x @ [0.3, -0.2] + rng.normal(size=n) * 0.1
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i]) if i < n - 2 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, label double")
    got = M.prequential(df, ["symbol"], ["a", "b"], "label", 0.001, least=20).orderBy("date").collect()
    for t in (25, 40, 59):
        past = pd.DataFrame(x[: t - 1]), y[: t - 1]
        mean, sd = past[0].mean().to_numpy(), past[0].std(ddof=0).to_numpy()
        z = ((past[0] - mean) / sd).to_numpy()
        beta = np.linalg.solve(z.T @ z / len(z) + np.eye(2), z.T @ (past[1] - past[1].mean()) / len(z))
        assert got[t].n_known == t - 1 and got[t].forecast == pytest.approx(past[1].mean() + beta @ np.clip((x[t] - mean) / sd, -5, 5))


def test_stopped_wealth_stays_lost(spark):
    rows = [("x", dt.date(2020, 1, 1 + i), c, -1.0) for i, c in enumerate([1.0, 2.5, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, position double")
    assert column(P.wealth(df, ["symbol"]), "wealth") == [1.0, 0.0, 0.0, 0.0]


def test_chart_reader_checks_identity_and_length(spark):
    doc = '{"chart":{"result":[{"meta":{"symbol":"A","exchangeTimezoneName":"America/New_York"},"timestamp":[1577923200,1577923260,1578009600],"indicators":{"quote":[{"close":[1.0,2.0,-1.0]}],"adjclose":[{"adjclose":[1.5,2.5,null]}]}}]}}'
    df = spark.createDataFrame([("A", doc), ("B", doc)], "symbol string, payload string")
    got = R.chart_bars(df, least=1).collect()
    assert [(r.symbol, str(r.date), r.close) for r in got] == [("A", "2020-01-01", 2.0)]
    assert R.chart_bars(df, least=2).count() == 0


def test_csv_holdings(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('Date,Account,StockTicker,CUSIP,SecurityName,Shares,Price,MarketValue,Weightings,NetAssets,SharesOutstanding\n09/04/2026,F,A,037833100,"Apple, Inc",10,5,50,50%,"$100",10\n09/04/2026,F,A,000000000,B,10,5,50,50%,"$100",10\n')
    rows = R.holdings_csv(spark, str(path))
    assert [(r.name, r.cusip, r.NetAssets) for r in rows.collect()] == [("Apple, Inc", "037833100", 100.0), ("B", None, 100.0)]
    assert [r.problem for r in R.snapshot_problems(rows).collect()] == ["repeated ticker"]


def test_top_up_needs_agreement(spark):
    d = dt.date
    bars = spark.createDataFrame([("A", d(2020, 1, 1), 1.0), ("B", d(2020, 1, 1), 1.0)], "symbol string, date date, close double")
    recent = spark.createDataFrame([("A", d(2020, 1, 1), 1.0), ("A", d(2020, 1, 2), 1.1), ("B", d(2020, 1, 1), 1.01), ("B", d(2020, 1, 2), 9.0)], "symbol string, date date, close double")
    assert sorted((r.symbol, str(r.date)) for r in R.topped_up(bars, recent).collect()) == [("A", "2020-01-01"), ("A", "2020-01-02"), ("B", "2020-01-01")]


def test_empty_tables(spark):
    empty = series(spark, [], "close")
    assert W.momentum(empty, ["symbol"]).count() == 0
    assert W.expanding_midrank(W.momentum(empty, ["symbol"]), ["symbol"]).count() == 0
    assert P.wealth(empty.withColumn("position", F.lit(1.0)), ["symbol"]).count() == 0


def test_leverage_is_a_ledger_of_risk_and_cash(spark):
    rng = np.random.default_rng(6)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
    target = [None if k % 4 else float(x) for k, x in enumerate(rng.choice([0.5, 1.0, 1.5], 120))]
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c), t) for i, (c, t) in enumerate(zip(close, target))]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, target double")
    got = K.leveraged(df, ["symbol"], 0.005, 0.05).orderBy("date").collect()
    units, cash = 1 / close[0], 0.0
    for i in range(1, 120):
        cash *= math.exp((0.05 if cash < 0 else 0.0) / 365.2425)
        wealth = units * close[i] + cash
        if target[i - 1] is not None:
            low, high = 0.0, wealth
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (low, mid) if mid + 0.005 * abs(target[i - 1] * mid - units * close[i]) > wealth else (mid, high)
            units, cash = target[i - 1] * low / close[i], low - target[i - 1] * low
        assert got[i].wealth == pytest.approx(units * close[i] + cash, rel=1e-9)
    falling = spark.createDataFrame([("x", dt.date(2020, 1, 1 + i), 1.0 - 0.2 * i, 2.0 if i == 0 else None) for i in range(5)], "symbol string, date date, close double, target double")
    path = [(round(r.wealth, 6), round(r.exposure, 6)) for r in K.leveraged(falling, ["symbol"], 0.0, 0.0, floor=0.4).orderBy("date").collect()]
    assert path == [(1.0, 1.0), (0.8, 2.0), (0.4, 0.0), (0.4, 0.0), (0.4, 0.0)]


def test_banded_schedule_keeps_small_moves(spark):
    ratios = [1.0, 1.05, 1.3, 1.25, 0.2, None, 9.0]
    df = spark.createDataFrame([("x", dt.date(2020, 1 + i, 1), r) for i, r in enumerate(ratios)], "symbol string, month date, ratio double")
    got = [r.target for r in D.banded_schedule(df, ["symbol"], 1.0, 1.5).orderBy("month").collect()]
    assert got == [1.0, 1.0, 1.3, 1.3, 0.5, 1.5]


def test_walk_forward_equals_refitting(spark):
    rng = np.random.default_rng(7)
    n = 90
    x = rng.normal(size=(n, 2))
    y = x @ [0.5, -1.0] + 0.2 + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(n)], "symbol string, date date, a double, b double, label double")
    got = D.walk_forward(df, ["symbol"], ["a", "b"], "label", 30, 7).orderBy("date").collect()
    assert len(got) == n - 30
    for k, r in enumerate(got):
        start = 30 + k // 7 * 7
        past = np.column_stack([np.ones(start - 1), x[: start - 1]])
        beta = np.linalg.lstsq(past, y[: start - 1], rcond=None)[0]
        assert r.forecast == pytest.approx(beta[0] + x[30 + k] @ beta[1:])


def test_residual_pls_equals_its_steps(spark):
    rng = np.random.default_rng(8)
    n = 200
    c, x = rng.normal(size=(n, 2)), rng.normal(size=(n, 3))
    x[:, 0] += c[:, 1]
    y = c @ [1.0, 2.0] + x @ [0.5, 0.2, 0.0] + rng.normal(size=n)
    df = spark.createDataFrame([("x", *map(float, c[i]), *map(float, x[i]), float(y[i])) for i in range(n)], "symbol string, c1 double, c2 double, x1 double, x2 double, x3 double, y double")
    got = {r.term: r.coefficient for r in M.residual_pls(df, ["symbol"], ["c1", "c2"], ["x1", "x2", "x3"], "y").collect()}
    base = np.column_stack([np.ones(n), c])
    left = lambda v: v - base @ np.linalg.lstsq(base, v, rcond=None)[0]
    rx, ry = left(x), left(y)
    z = rx / rx.std(axis=0)
    w = z.T @ ry
    w /= np.linalg.norm(w)
    score = z @ w
    fit = base @ np.linalg.lstsq(base, y, rcond=None)[0] + score * (score @ ry) / (score @ score)
    mine = got["intercept"] + c @ [got["c1"], got["c2"]] + x @ [got["x1"], got["x2"], got["x3"]]
    assert mine == pytest.approx(fit)


def test_fund_report(spark):
    xml = "<formData><genInfo><regCik>1234</regCik><seriesId>S1</seriesId><repPdDate>2026-06-30</repPdDate></genInfo><fundInfo><netAssets>100.5</netAssets></fundInfo><invstOrSecs><invstOrSec><name>CUT NAM</name><title>Cut Name Corporation</title><cusip>037833100</cusip><identifiers><isin value='US0378331005'/></identifiers><balance>5</balance><valUSD>50</valUSD><assetCat>EC</assetCat></invstOrSec><invstOrSec><name>First Money Market</name><title>5% Notes</title><cusip>000000000</cusip><balance>1</balance><valUSD>1</valUSD><assetCat>STIV</assetCat></invstOrSec></invstOrSecs></formData>"
    rows = R.fund_reports(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.name, r.cusip, r.isin, r.cik, r.net_assets) for r in rows] == [("Cut Name Corporation", "037833100", "US0378331005", "0000001234", 100.5), ("First Money Market", None, None, "0000001234", 100.5)]


def test_freshness_of_files(spark):
    d = dt.date
    checked, session = d(2024, 5, 31), d(2024, 6, 3)
    df = spark.createDataFrame([(x, checked, session) for x in (d(2024, 6, 3), d(2024, 6, 4), d(2024, 5, 31), d(2024, 5, 26), d(2024, 5, 25))], "file date, checked date, session date")
    got = [r.s for r in df.select(B.freshness(F.col("file"), F.col("checked"), F.col("session")).alias("s")).collect()]
    assert got == ["next", "future", "fresh", "fresh", "stale"]


def test_newest_observation(spark):
    d = dt.date
    history = spark.createDataFrame([("a", d(2024, 1, 1), 10.0), ("a", d(2024, 1, 2), 11.0), ("b", d(2024, 1, 2), 5.0), ("c", d(2024, 1, 9), None), ("e", d(2024, 1, 3), 7.0)], "k string, date date, nav double")
    daily = spark.createDataFrame([("a", d(2024, 1, 1), 10.0, 1.0), ("b", d(2024, 1, 2), 5.5, 2.0), ("c", d(2024, 1, 1), 3.0, None), ("d", None, 1.0, 0.0)], "k string, date date, nav double, change double")
    got = {r.k: (r.nav, r.change and round(r.change, 6), r.source, r.lags) for r in B.newest_observation(daily, history, ["k"]).collect()}
    assert got == {"a": (11.0, 10.0, "historical", True), "b": (5.5, 2.0, "daily", False), "c": (3.0, None, "daily", False), "e": (7.0, None, "historical", False)}


def test_totals_against_declared(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "k string, v long")
    declared = spark.createDataFrame([("a", 2, 11), ("b", 2, 1), ("c", 1, 4), ("d", 0, 0)], "k string, declared_n long, declared_total long")
    assert {r.k: r.problem for r in B.total_mismatches(rows, declared, ["k"], "v").collect()} == {"b": "entries", "c": "entries and value"}


def test_sign_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -0.5), ("a", 2.0), ("b", 1.0), ("b", -1.0), ("c", None)], "k string, slope double")
    got = {r.k: (r.blocks, r.positive, r.negative, r.zero, r.dominant) for r in B.sign_summary(df, ["k"], "slope").collect()}
    assert got == {"a": (3, 2, 1, 0, "positive"), "b": (2, 1, 1, 0, None), "c": (1, 0, 0, 1, None)}


def test_order_of_fund_reports(spark):
    kind = "cik int, accession string, form string, report string, filed string, accepted string, document string"
    rows = [(1, "a", "NPORT-P", "2024-03-31", "2024-05-01", None, None), (1, "b", "NPORT-P/A", "2024-03-31", "2024-05-02", "2024-05-02T1", "x/p.xml"), (1, "c", "NPORT-P", "2024-06-30", "2024-08-01", None, "d/"), (1, "d", "NPORT-P", None, "2024-08-01", None, None), (1, "e", None, "2024-06-30", "2024-08-01", None, None)]
    got = [(r.accession, r.document) for r in B.report_order(spark.createDataFrame(rows, kind), ["cik"]).orderBy("place").collect()]
    assert got == [("c", "primary_doc.xml"), ("b", "p.xml"), ("a", "primary_doc.xml")]


def test_quotes_of_short_series(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, i), p, c) for i, p, c in ((1, 1.0, 1.0), (2, 2.0, None), (3, 3.0, 3.0))] + [("b", d(2024, 1, 1), 4.0, 4.0)], "symbol string, date date, price double, close double")
    assert {r.symbol: (r.price, r.previous) for r in B.quotes(df, ["symbol"]).collect()} == {"a": (3.0, 1.0), "b": (4.0, None)}


def test_malformed_documents_give_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "{"), (3, '{"data": [{"value": "x", "timestamp": "1"}, {"value": "5", "timestamp": null}]}'), (4, '{"data": [{"value": "7", "timestamp": "86400"}, {"value": "8", "timestamp": "86400"}]}')], "k int, payload string")
    assert [(r.k, r.value, r.previous, r.label) for r in R.latest_readings(docs, ["k"]).collect()] == [(4, 7.0, 8.0, "")]
    covers = spark.createDataFrame([(1, "<e><formData><coverPage><isAmendment>YES</isAmendment></coverPage></formData></e>"), (2, None)], "k int, xml string")
    got = {r.k: (r.manager, r.report, r.amends, r.entries) for r in R.filing_headers(covers).collect()}
    assert got == {1: (None, None, True, None), 2: (None, None, False, None)}


def test_path_with_a_gap(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 1.0), ("b", 1, 1.0), ("b", 3, 2.0), ("c", 5, 1.0), ("d", 1, 0.0), ("d", 2, 1.0)], "k string, index int, wealth double")
    got = {r.k: (r.intervals, r.factor, r.drawdown, r.valid) for r in B.path_summary(df, ["k"], 252).collect()}
    assert got["a"] == (2, 1.0, 0.5, True) and got["b"] == (1, 2.0, 0.0, False) and got["c"][0] == 0 and got["c"][1] is None and got["c"][3] and not got["d"][3]


def test_rows_matched_by_the_strong_key_need_no_weak_one(spark):
    from moodtide.operators import holdings as H

    columns = "g int, cusip string, ticker string, shares double"
    before = spark.createDataFrame([(1, "a", None, 1.0), (1, "b", "B", 2.0), (1, None, "C", 3.0), (1, None, None, 4.0), (2, "a", "A", 5.0)], columns)
    after = spark.createDataFrame([(1, "a", None, 6.0), (1, None, "B", 7.0), (1, "c", "C", 8.0), (1, None, None, 9.0)], columns)
    got = sorted((r.g, r.shares_from or 0, r.shares_to or 0) for r in H.matched(before, after, ["g"], "cusip", "ticker").collect())
    assert got == [(1, 0, 9.0), (1, 1.0, 6.0), (1, 2.0, 7.0), (1, 3.0, 8.0), (1, 4.0, 0), (2, 5.0, 0)]


def test_largest_entries_are_limited_before_they_travel(spark):
    from moodtide.plans import disclosure

    plan = disclosure.trade_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
