"""The grid of rules over the regions: context, results, selection in development, holdout, placebo."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grid as G, policies as K, scan, sealed, windows as W
from ..operators.lineage import cut, folder
from ..sources.bars import REGION_SQL, SLOT_SQL, SLOTS, region_bars, slot_bars
from .sentiment import rounded
from .signals import _A, _C, _MOVED, _N, _R, _RAW, _appetite, six_components

S = ["symbol"]
PLACEBOS = 39


def _context(spark, sf_dir):
    bars = region_bars(spark, sf_dir)
    damped = bars.withColumn("close", F.pow("close", 0.025))
    return G.context(six_components(spark, sf_dir).withColumn("score", sum(F.col(c) for c in G.COMPONENTS) / 6), damped, S)


def _paths(spark, sf_dir):
    """All rules over all bars; the bars are written first, since the length of the longest series is wanted before the paths."""
    bars = cut(_context(spark, sf_dir))
    longest = bars.agg(F.max("n")).first()[0] or 0
    return G.paths(G.stages(bars).crossJoin(F.broadcast(G.rule_table(spark))), S, longest)  # 47 rules


def _results(spark, sf_dir):
    return rounded(G.results(_paths(spark, sf_dir), S, G.COSTS), "wealth", "ratio", "drawdown", "exposure")


def rule_context(spark, sf_dir):
    """Every bar's features after the warm-up."""
    return rounded(_context(spark, sf_dir).select("symbol", "date", "i", "n", *(F.col("features")[k].alias(f) for k, f in enumerate(G.FEATURES))), *G.FEATURES)


def rule_grid(spark, sf_dir):
    """All rules in both stages at all costs, begun in the market."""
    return _results(spark, sf_dir).drop("place")


def rule_cash_start(spark, sf_dir):
    """The state after each stage's last bar from either start, which one scan gives, and the bars that it takes until both agree for good."""
    out, in_ = (scan.image(F.col("state"), s, 2) for s in (0, 1))
    p = _paths(spark, sf_dir).withColumn("from_out", out).withColumn("from_in", in_)
    return p.groupBy(*S, "stage", "rule").agg(F.max_by("from_out", "at").alias("from_out"), F.max_by("from_in", "at").alias("from_in"), F.sum((F.col("from_out") != F.col("from_in")).cast("int")).alias("bars_apart"))


def rule_selection(spark, sf_dir):
    return G.selection(_results(spark, sf_dir), S)


def rule_shared(spark, sf_dir):
    """The one rule for all regions, if there is any, with each region's ratio in the holdout and whether it wins at base and stress costs."""
    done = _results(spark, sf_dir)
    first = G.shared_selection(done, S)
    later = G.wide(done.filter("stage = 'holdout'"), S).join(F.broadcast(first), "rule")  # one row
    return rounded(later.select("symbol", "rule", "objective", "base", "stress", ((F.col("base") > 1) & (F.col("stress") > 1)).alias("wins")), "objective")


def rule_holdout(spark, sf_dir):
    """What development selected, and the controls, in the holdout; a rule wins if it beats holding at base and stress costs."""
    done = _results(spark, sf_dir)
    chosen = G.selection(done, S, 1).filter("rank = 1").select("symbol", "rule", F.lit("selected").alias("role"))
    later = G.wide(done.filter("stage = 'holdout'"), S)
    both = later.join(chosen, ["symbol", "rule"], "left").withColumn("role", F.when(F.col("family") == "control", "control").otherwise(F.col("role"))).filter("role is not null")
    return both.select("symbol", "rule", "role", "base", "stress", "trades", "exposure", ((F.col("base") > 1) & (F.col("stress") > 1)).alias("wins"))


def rule_placebo(spark, sf_dir):
    """The controls that join price with sentiment, in the holdout, against the same rules on sentiment moved round; gates stay on their dates."""
    gated = G.rule_table(spark).filter("family = 'gated'")
    held = G.stages(cut(_context(spark, sf_dir))).filter("stage = 'holdout'")
    w = W.Window.partitionBy(*S)
    own = held.withColumn("i", F.row_number().over(W.series(S)) - 1).withColumn("n", F.count("*").over(w))
    keys = [*S, "offset"]
    moved = G.shifted(own, S, F.concat(F.array(F.lit(0).cast("long")), K.shift_offsets(F.col("n"), PLACEBOS)))
    longest = held.groupBy(*S).count().agg(F.max("count")).first()[0] or 0
    done = G.results(G.paths(moved.crossJoin(F.broadcast(gated)), keys, longest), keys, {"base": G.COSTS["base"]})
    x = rounded(done.select(*keys, "rule", "wealth"), "wealth")
    actual = x.filter("offset = 0").select("symbol", "rule", F.col("wealth").alias("actual"))
    both = x.filter("offset > 0").join(actual, ["symbol", "rule"])
    v = F.col("wealth")
    below, ties = F.count(F.when(v < F.col("actual"), 1)), F.count(F.when(v == F.col("actual"), 1))
    done = both.groupBy("symbol", "rule", "actual").agg(
        F.count("*").alias("shifts"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("most"), ties.alias("ties"), (F.min(v) == F.max(v)).alias("degenerate"),
        ((below + 0.5 * ties) / F.count("*")).alias("percentile"), ((1 + F.count("*") - below) / (1 + F.count("*"))).alias("p"),
    )
    return rounded(done, "median", "percentile", "p")


def sealed_holdout(spark, sf_dir):
    """What development selected, in the holdout, which is read only after the selection was sealed and the seal was found whole."""
    bars = cut(_context(spark, sf_dir))
    place = f"{folder(spark)}/sealed-{uuid.uuid4().hex}"
    sealed.deal(G.stages(bars), place)
    rules = G.rule_table(spark)

    def evaluate(rows, chosen):
        longest = rows.agg(F.max("n")).first()[0] or 0
        done = G.results(G.paths(rows.join(F.broadcast(chosen), S) if "symbol" in chosen.columns else rows.crossJoin(F.broadcast(chosen)), S, longest), S, G.COSTS)  # 47 rules at most
        return rounded(done, "wealth", "ratio", "drawdown", "exposure")

    def select(rows):
        return G.selection(evaluate(rows, rules), S, 1).filter("rank = 1").select("symbol", "rule")

    sealed.seal(spark, place, select)
    ledger, later = sealed.opened(spark, place, select)
    done = G.wide(evaluate(later, ledger.join(rules, "rule")), S)
    return done.select("symbol", "rule", "base", "stress", "trades", "exposure", ((F.col("base") > 1) & (F.col("stress") > 1)).alias("wins"))


QUERIES = {f.__name__: f for f in (rule_context, rule_grid, rule_cash_start, rule_selection, rule_shared, rule_holdout, rule_placebo, sealed_holdout)}


# ---- the same in SQL: each rule's last decision instead of maps ----

_W = "over (partition by symbol order by date)"


def _mean(x: str, n: int) -> str:
    w = f"over (partition by symbol order by date rows {n - 1} preceding)"
    return f"case when count({x}) {w} = {n} then avg({x}) {w} end"


SIX_SQL = f"""{REGION_SQL}, {SLOT_SQL}, {_MOVED}, {_RAW}, {_appetite('select * from region_bars', _A, 'p')}, {_appetite(_N, _R, 'q')},
seg as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from slot_bars where symbol in ('{SLOTS["small"]}', '{SLOTS["large"]}')),
segs as (select date, ln(close / {_mean('close', 100)}) as g, case when count(r) over (partition by symbol order by date rows 62 preceding) = 63 then stddev_samp(r) over (partition by symbol order by date rows 62 preceding) end as sd from seg),
part as (select date, avg({_C('50 + 25 * g / (sd * sqrt(20.0))')}) as breadth, count(*) as k from segs where g is not null group by date having count(*) >= 2),
six as (select c.symbol, c.date, trend_score as trend, strength_score as strength, volatility_score as volatility, {_C('50 + 25 * p.appetite')} as safe, {_C('50 + 25 * q.appetite')} as credit, breadth
  from comps c join p on c.symbol = p.symbol and c.date = p.date join q on c.date = q.date join part on part.date = c.date
  where c.strength is not null and c.volatility is not null and p.appetite is not null and q.appetite is not null)"""
_VOTES = " + ".join(f"({c} > 50)::int" for c in G.COMPONENTS)
CONTEXT_SQL = f"""{SIX_SQL}, sc as (select *, ({' + '.join(G.COMPONENTS)}) / 6 as score from six),
ft as (select *, floor(floor(score * 10 + 0.5) / 10 + 0.5) as shown, {_VOTES} as votes, row_number() {_W} as k, {', '.join(f"{_mean('score', n)} as mean_{n}" for n in (21, 63, 126))}, {', '.join(f"lag(score, {n}) {_W} as lag_{n}" for n in (5, 21, 63))},
  {', '.join(f"{_mean(c, 63)} as {c}_mean" for c in G.COMPONENTS)} from sc),
dm as (select symbol, date, pow(close, 0.025) as close from region_bars), gt as (select *, (close > {_mean('close', 125)})::int as above_125, (close > {_mean('close', 210)})::int as above_210 from dm),
cx as materialized (select ft.*, gt.close, above_125, above_210, row_number() over (partition by ft.symbol order by ft.date) - 1 as i, count(*) over (partition by ft.symbol) as n from ft join gt on ft.symbol = gt.symbol and ft.date = gt.date where k > {G.WARM_UP})"""


def _condition(p: tuple) -> str:
    feature, op, other, constant, gate, how = p
    compared = f"{G.FEATURES[feature]} {op} {G.FEATURES[other] if other is not None else constant}"
    return f"({compared} {how} {G.FEATURES[gate]} > 0)" if how else compared


def _events(rules) -> str:
    return " union all ".join(
        f"select *, '{r}' as rule, '{f}' as family, {k} as place, case when {_condition(e)} then 1 when {_condition(lv) if lv else 'true'} then 0 end as ev from st" for k, (r, f, e, lv) in enumerate(rules)
    )


def path_sql(rules, start: int = 1, staged: str = "", keys: str = "symbol, stage, rule") -> str:
    staged = staged or f"select * from (select *, unnest(case when i < ceil(n * {G.DEVELOPMENT}) - 1 then ['development'] when i = ceil(n * {G.DEVELOPMENT}) - 1 then ['development', 'holdout'] else ['holdout'] end) as stage from cx)"
    w = f"over (partition by {keys} order by date)"
    return f"""st as ({staged}), ev as ({_events(rules)}),
af as (select *, coalesce(last_value(ev ignore nulls) over (partition by {keys} order by date rows between unbounded preceding and current row), {start}) as after, row_number() {w} as seq from ev),
tg as (select *, coalesce(lag(after) {w}, {start}) as target from af), hd as (select *, coalesce(lag(target) {w}, {start}) as held, close / lag(close) {w} as move from tg),
pt as materialized (select *, (target <> held)::int as traded from hd)"""


def result_sql(keys: str = "symbol, stage, rule", costs=G.COSTS) -> str:
    w = f"over (partition by {keys}, scenario order by date)"
    values = ", ".join(f"('{s}', {c}::double)" for s, c in costs.items())
    return f"""cs as (select pt.*, scenario, exp(sum(ln(case when held = 1 then coalesce(move, 1) else 1 end) + traded * ln(1 - cost)) {w}) as wealth from pt, (values {values}) v(scenario, cost)),
dd as (select *, wealth / max(wealth) {w} - 1 as down from cs),
rs as materialized (select {keys}, family, place, scenario, round(max_by(wealth, seq), 6) as wealth, round(max_by(wealth, seq) / (max_by(close, seq) / min_by(close, seq)), 6) as ratio, round(min(down), 6) as drawdown, sum(traded)::bigint as trades,
  sum(traded * target)::bigint as cycles, round(sum(held) filter (seq > 1) / (count(*) - 1), 6) as exposure, max_by((after <> target)::int, seq) as pending, max_by(target, seq) as invested from dd group by {keys}, family, place, scenario)"""


_RULES = G.rule_list()
_DONE = f"with {CONTEXT_SQL}, {path_sql(_RULES)}, {result_sql()}"
_WIDE = "wd as (select symbol, stage, rule, family, place, trades, exposure, max(ratio) filter (scenario = 'base') as base, max(ratio) filter (scenario = 'stress') as stress from rs group by all)"
_GOOD = f"gd as (select *, row_number() over (partition by symbol order by base desc, trades, rule) as rank, count(*) over (partition by symbol) as eligible from wd where stage = 'development' and family <> 'control' and base > 1 and stress > 1 and trades >= {G.LEAST_TRADES})"
ORACLES = {
    "strict_composite": f"with {SIX_SQL}, sc as (select symbol, date, ({' + '.join(G.COMPONENTS)}) / 6 as score from six) select symbol, date, round(score, 6) as score, floor(score * 10 + 0.5) / 10 as rounded from sc",
    "rule_context": f"with {CONTEXT_SQL} select symbol, date, i, n, {', '.join(f'round({f}, 6) as {f}' for f in G.FEATURES)} from cx",
    "rule_grid": f"{_DONE} select * exclude (place) from rs",
    "rule_cash_start": f"""with {CONTEXT_SQL}, {path_sql(_RULES)}, o as (select symbol, stage, rule, seq, after as a1, coalesce(last_value(ev ignore nulls) over (partition by symbol, stage, rule order by date rows between unbounded preceding and current row), 0) as a0 from pt)
select symbol, stage, rule, max_by(a0, seq) as from_out, max_by(a1, seq) as from_in, sum((a0 <> a1)::int)::bigint as bars_apart from o group by 1, 2, 3""",
    "rule_selection": f"{_DONE}, {_WIDE}, {_GOOD} select s.symbol, coalesce(rank, 0) as rank, coalesce(eligible, 0) as eligible, rule, base, stress, trades, exposure from (select distinct symbol from wd) s left join (select * from gd where rank <= 5) g on s.symbol = g.symbol",
    "rule_shared": f"""{_DONE}, {_WIDE}, sh as (select rule, ln(min(base)) as objective from wd where stage = 'development' and family <> 'control' group by rule, place having min(base) > 1 and min(stress) > 1 order by min(base) desc, place limit 1)
select symbol, rule, round(objective, 6) as objective, base, stress, base > 1 and stress > 1 as wins from wd join sh using (rule) where stage = 'holdout'""",
    "rule_holdout": f"""{_DONE}, {_WIDE}, {_GOOD}, ro as (select symbol, rule, 'selected' as role from gd where rank = 1 union all select distinct symbol, rule, 'control' from wd where family = 'control')
select symbol, rule, role, base, stress, trades, exposure, base > 1 and stress > 1 as wins from wd join ro using (symbol, rule) where stage = 'holdout'""",
    "sealed_holdout": f"""{_DONE}, {_WIDE}, {_GOOD} select w.symbol, w.rule, w.base, w.stress, w.trades, w.exposure, w.base > 1 and w.stress > 1 as wins from wd w join gd on gd.symbol = w.symbol and gd.rule = w.rule and gd.rank = 1 where w.stage = 'holdout'""",
    "rule_placebo": f"""with {CONTEXT_SQL}, ho as (select *, row_number() {_W} - 1 as j, count(*) over (partition by symbol) as m from cx where i >= ceil(n * {G.DEVELOPMENT}) - 1),
of as (select symbol, 0 as "offset" from ho group by 1 union select distinct symbol, floor(t.k * m / {PLACEBOS + 1}.0)::bigint from ho, range(1, {PLACEBOS + 1}) as t(k) where floor(t.k * m / {PLACEBOS + 1}.0) > 0),
{path_sql([r for r in _RULES if r[1] == 'gated'], staged='select a.symbol, a.date, a.close, a.above_125, a.above_210, o."offset", b.* exclude (symbol, date, close, above_125, above_210), ' + "'holdout' as stage" + ' from ho a join of o on a.symbol = o.symbol join ho b on b.symbol = a.symbol and (b.j + o."offset") % b.m = a.j', keys='symbol, "offset", rule')},
{result_sql('symbol, "offset", rule', {"base": G.COSTS["base"]})}, ac as (select symbol, rule, wealth as actual from rs where "offset" = 0)
select symbol, rule, actual, count(*) as shifts, min(wealth) as least, round(median(wealth), 6) as median, max(wealth) as most, count(*) filter (wealth = actual) as ties, min(wealth) = max(wealth) as degenerate,
  round((count(*) filter (wealth < actual) + 0.5 * count(*) filter (wealth = actual)) / count(*), 6) as percentile, round((1 + count(*) filter (wealth >= actual)) / (1 + count(*))::double, 6) as p
from rs join ac using (symbol, rule) where "offset" > 0 group by symbol, rule, actual""",
}
