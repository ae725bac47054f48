"""Ledgers of decisions on the regions' scores: their timeline, replay under costs, figures had again, errors of their forecasts, attestations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as L, windows as W
from ..operators.lineage import cut
from ..sources.bars import table
from .trading import DAMPED, S, scored

COSTS = [0.0025, 0.005]
FIRST = 300
FIELDS = ["intervals", "wealth", "growth", "volatility", "drawdown", "exposure", "fills", "cost_sum", "cost_multiplier", "long", "cash", "episodes"]


def _bars(spark, sf_dir):
    w = W.series(S)
    return scored(spark, sf_dir).withColumn("index", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(W.Window.partitionBy(*S)))


def _ledger(bars):
    """LONG up to a displayed score of 50, from the 300th bar to the last but one."""
    target = F.when(F.floor(F.floor(F.col("score") * 10 + 0.5) / 10 + 0.5) <= 50, L.LONG).otherwise(L.CASH)
    return L.ledger(bars.filter((F.col("index") >= FIRST) & (F.col("index") < F.col("__n") - 1)).select(*S, "index", "date", target.alias("target")), S)


def decision_timeline(spark, sf_dir):
    """A ledger in which every field is made wrong on some days."""
    bars = _bars(spark, sf_dir)
    on = lambda k: F.col("index") % k == 0
    rows = _ledger(bars).withColumns({
        "ordinal": F.col("ordinal") + on(97).cast("int"), "execution": F.when(~on(89), F.col("execution")), "action": F.when(on(83), "HOLD").otherwise(F.col("action")),
        "filled": F.when(on(79), F.when(F.col("filled") == L.LONG, L.CASH).otherwise(L.LONG)).otherwise(F.col("filled")), "traded": F.col("traded") != on(73),
        "digest": F.when(on(71), F.upper("digest")).otherwise(F.col("digest")), "date": F.date_add("date", on(67).cast("int")),
    })
    return L.timeline_problems(rows.filter(~on(61)), bars, S)


def replayed_path(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    out = L.path(_ledger(bars), bars, S, COSTS)
    return out.select("symbol", "cost", "index", "date", F.round("wealth", 6).alias("wealth"), "position", "fill", "charged", F.round("drawdown", 6).alias("drawdown"))


def _figures(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    decisions = _ledger(bars)
    return L.figures(L.path(decisions, bars, S, COSTS), decisions, S)


def replayed_figures(spark, sf_dir):
    out = _figures(spark, sf_dir)
    reals = {c: F.round(c, 6) for c in ("wealth", "growth", "volatility", "drawdown", "exposure", "cost_sum", "cost_multiplier")}
    return out.withColumns(reals)


def recomputed_figures(spark, sf_dir):
    """Reported figures, some of them wrong, one region's left out, against those had again from the decisions."""
    again = cut(_figures(spark, sf_dir))  # both sides read it
    a = F.col("symbol").startswith("A")
    reported = again.filter("symbol <> 'EUROPE'").withColumns({
        "fills": F.col("fills") + (F.col("cost") == COSTS[1]).cast("int"), "wealth": F.col("wealth") * F.when(a, 1.001).otherwise(1.0), "growth": F.col("growth") + 1e-12, "volatility": F.when(~a, F.col("volatility")),
    })
    out = L.differences(reported, again, ["symbol", "cost"], FIELDS)
    return out.withColumns({c: F.round(c, 6) for c in ("reported", "recomputed")})


def forecast_errors(spark, sf_dir):
    """The mean of the last 252 log returns as forecast of each decision; a tenth of them say why there should be none."""
    bars = _bars(spark, sf_dir).withColumn("r", W.log_return(F.col("close"), S))
    known = bars.select(*S, "index", F.count("r").over(W.over(S)).alias("trained"), F.avg("r").over(W.over(S, 251)).alias("forecast"))
    decisions = known.filter("index >= 200").withColumn("reason", F.when(F.col("index") % 10 == 0, "no fit"))
    out = L.forecast_errors(decisions, bars, S)
    return out.withColumns({"sse": F.round("sse", 6), "mse": F.round("mse", 9)})


def scoreability(spark, sf_dir):
    """Suppliers' attestations as nested documents, some without one, read back and judged."""
    k = F.col("s_suppkey")
    side = lambda m, n, currency: F.struct((k % m != 0).alias("executable"), F.when(k % n == 0, "price").otherwise("total_return").alias("returns"), currency.alias("currency"))
    text = F.to_json(F.struct(
        side(3, 5, F.when(k % 17 != 0, "USD")).alias("risky"), side(13, 6, F.when(k % 7 == 0, "EUR").otherwise("USD")).alias("cash"),
        (k % 9 != 0).alias("same_benchmark"), F.when(k % 8 != 0, True).alias("cash_in_labels"), (k % 10 != 0).alias("frozen"),
    ))
    rows = table(spark, sf_dir, "supplier").select(k, F.when(k % 11 != 0, text).alias("text"), F.when(k % 4 == 0, F.array(F.lit("daily"), F.lit("Cash return is fixed at ZERO."))).when(k % 4 == 1, F.array(F.lit("daily"))).alias("limits"))
    reasons = L.scoreability(F.from_json("text", L.ATTESTATION), F.col("limits"))
    return rows.select("s_suppkey", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("scorable"))


QUERIES = {f.__name__: f for f in (decision_timeline, replayed_path, replayed_figures, recomputed_figures, forecast_errors, scoreability)}

_LEDGER = f"""{DAMPED}, d as (select *, case when target = 'LONG' then 'BUY' else 'SELL' end as action, i + 1 as execution, row_number() over w - 1 as ordinal, coalesce(lag(target) over w, 'LONG') as filled
  from (select symbol, date, i, case when shown <= 50 then 'LONG' else 'CASH' end as target from b where i >= {FIRST} and i < n - 1) window w as (partition by symbol order by i))"""
#: The position held from a bar on is the target of the decision on the bar before.
_PATH = f"""{_LEDGER}, h as (select b.symbol, b.i, b.date, b.close, d.filled as position, case when d.ordinal > 0 then d.filled end as fill from b join d on b.symbol = d.symbol and b.i = d.i),
g as (select *, lag(position) over w as held, case when lag(position) over w = 'LONG' then close / lag(close) over w else 1 end as move from h window w as (partition by symbol order by i)),
c as (select *, coalesce(position <> held, false) as changed, case when position <> held then cost else 0 end as charged from g, (values (0.0025::double), (0.005::double)) v(cost)),
p as (select *, exp(sum(ln(move * (1 - charged))) over (partition by symbol, cost order by i)) as wealth from c),
q as (select *, 1 - wealth / max(wealth) over w as drawdown, wealth / lag(wealth) over w - 1 as net from p window w as (partition by symbol, cost order by i))"""
_FIGURES = f"""{_PATH}, f as (select symbol, cost, count(*) - 1 as intervals, max_by(wealth, i) as wealth, stddev_samp(net) * sqrt(252) as volatility, max(drawdown) as drawdown, count(*) filter (held = 'LONG') / (count(*) - 1)::double as exposure, count(*) filter (changed) as fills from q group by 1, 2),
s as (select symbol, count(*) filter (target = 'LONG') as long, count(*) filter (target = 'CASH') as cash, count(*) filter (target = 'LONG' and filled = 'CASH') as episodes, sha256(string_agg(i || ':' || execution || ':' || action || ':' || target, chr(10) order by i)) as ledger from d group by 1),
u as (select symbol, cost, intervals, wealth, ln(wealth) * 252 / intervals as growth, volatility, drawdown, exposure, fills, fills * cost as cost_sum, pow(1 - cost, fills) as cost_multiplier, long, cash, episodes, ledger from f join s using (symbol))"""
_ATTEST = """select s_suppkey, s_suppkey % 11 <> 0 as given, s_suppkey as k from supplier"""
_REASONS = (
    ("BENCHMARK_NOT_SAME_RISKY_INSTRUMENT", "given and k % 9 = 0"), ("CASH_INSTRUMENT_NOT_EXECUTABLE", "given and k % 13 = 0"), ("CASH_INSTRUMENT_NOT_TOTAL_RETURN", "given and k % 6 = 0"),
    ("CASH_RETURN_NOT_INCLUDED_IN_LABELS_AND_LEDGERS", "given and k % 8 = 0"), ("MISSING_SCOREABILITY_ATTESTATION", "not given"), ("RISKY_CASH_CURRENCY_MISMATCH", "given and (k % 17 = 0 or k % 7 = 0)"),
    ("RISKY_INSTRUMENT_NOT_EXECUTABLE", "given and k % 3 = 0"), ("RISKY_INSTRUMENT_NOT_TOTAL_RETURN", "given and k % 5 = 0"), ("TARGET_IDENTITY_NOT_FROZEN", "given and k % 10 = 0"), ("ZERO_RETURN_CASH_LEDGER", "k % 4 = 0"),
)
_REASON_LIST = "[x for x in [" + ", ".join(f"case when {when} then '{name}' end" for name, when in _REASONS) + "] if x is not null]"
ORACLES = {
    "decision_timeline": f"""with {_LEDGER}, k as (select *, row_number() over (partition by symbol order by i) - 1 as place, lag(i) over (partition by symbol order by i) as before, lag(target) over (partition by symbol order by i) as stood from d where i % 61 <> 0),
e as (select *, case when place = 0 then 'LONG' else stood end as expected, case when i % 79 = 0 then case when filled = 'LONG' then 'CASH' else 'LONG' end else filled end as said, (target <> filled) <> (i % 73 = 0) as moved from k),
x as (select symbol, place, unnest([case when ordinal + (i % 97 = 0)::int <> place then 'ordinal' end, case when place > 0 and i <> before + 1 then 'gap' end, case when i % 67 = 0 then 'date' end, case when i % 89 = 0 then 'execution' end, case when i % 83 = 0 then 'action' end,
  case when said <> expected then 'filled' end, case when moved <> (target <> expected) then 'traded' end, case when i % 97 = 0 or i % 89 = 0 or i % 83 = 0 or i % 79 = 0 or i % 73 = 0 or i % 71 = 0 or i % 67 = 0 then 'digest' end]) as problem from e)
select * from x where problem is not null""",
    "replayed_path": f"with {_PATH} select symbol, cost, i as index, date, round(wealth, 6) as wealth, position, fill, charged, round(drawdown, 6) as drawdown from q",
    "replayed_figures": f"with {_FIGURES} select symbol, cost, intervals, round(wealth, 6) as wealth, round(growth, 6) as growth, round(volatility, 6) as volatility, round(drawdown, 6) as drawdown, round(exposure, 6) as exposure, fills, round(cost_sum, 6) as cost_sum, round(cost_multiplier, 6) as cost_multiplier, long, cash, episodes, ledger from u",
    "recomputed_figures": f"""with {_FIGURES}, v as (unpivot (select symbol, cost, {', '.join(f'{c}::double as {c}' for c in FIELDS)} from u) on {', '.join(FIELDS)} into name field value recomputed),
r as (select symbol, cost, field, case when symbol = 'EUROPE' or (field = 'volatility' and symbol like 'A%') then null when field = 'fills' and cost = 0.005 then recomputed + 1 when field = 'wealth' and symbol like 'A%' then recomputed * 1.001 else recomputed end as reported, recomputed from v)
select symbol, cost, field, round(reported, 6) as reported, round(recomputed, 6) as recomputed from r where reported is distinct from recomputed""",
    "forecast_errors": f"""with {DAMPED}, r as (select symbol, i, close, ln(close / lag(close) over (partition by symbol order by i)) as r from b),
f as (select symbol, i, count(r) over (partition by symbol order by i) as trained, avg(r) over (partition by symbol order by i rows 251 preceding) as forecast, ln(lead(close, 2) over w / lead(close) over w) as actual from r window w as (partition by symbol order by i))
select symbol, count(actual) as origins, round(sum((actual - forecast) ** 2), 6) as sse, round(avg((actual - forecast) ** 2), 9) as mse, count(*) filter (trained < 252) as early, count(*) filter (i % 10 = 0) as unsound from f where i >= 200 and forecast is not null group by 1""",
    "scoreability": f"with a as ({_ATTEST}), l as (select s_suppkey, {_REASON_LIST} as reasons from a) select s_suppkey, coalesce(array_to_string(reasons, ','), '') as reasons, len(reasons) = 0 as scorable from l",
}
