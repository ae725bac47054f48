"""Statistics of scores and the outcomes that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import normal_cdf
from ..operators import outcomes as O, stats as T, windows as W
from ..sources.bars import REGION_SQL, region_bars, slot_bars, SLOT_SQL
from .outcomes import SCORE_SQL, momentum_scores
from .sentiment import label_sql, rounded

S = ["symbol"]


def observations(spark, sf_dir):
    scores = momentum_scores(spark, sf_dir)
    return scores.join(O.forward_returns(scores.select("symbol", "date", "close"), S), ["symbol", "date"]).filter("score is not null")


OBS_SQL = SCORE_SQL + ", " + """obs as (select * from (select symbol, date, close, score, """ + ", ".join(f"lead(close, {1 + h}) over w / lead(close, 1) over w - 1 as fwd_{h}" for h in (1, 5, 21, 63)) + """ from steps window w as (partition by symbol order by date)) where score is not null)"""


def return_summary(spark, sf_dir):
    r = region_bars(spark, sf_dir).withColumn("r", W.log_return(F.col("close"), S))
    out = T.summary(r, S, "r")
    return rounded(out, *[c for c in out.columns if c not in ("symbol", "n")])


def score_correlations(spark, sf_dir):
    return rounded(T.correlations(observations(spark, sf_dir), S, "score", "fwd_5"), "pearson", "spearman", "slope", "intercept")


def _slopes(spark, sf_dir):
    """All horizons in one pass: a horizon is a key like the region."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in (1, 5, 21))))
    long = observations(spark, sf_dir).select("symbol", "date", "score", each.alias("o")).select("symbol", "date", "score", "o.horizon", "o.y")
    return T.newey_west_slope(long, ["symbol", "horizon"], "score", "y", F.col("horizon"))


def hac_slope(spark, sf_dir):
    return rounded(_slopes(spark, sf_dir), "slope", "se", "z", "p")


def multiplicity(spark, sf_dir):
    """Adjusted p of all slope tests as one family."""
    tests = _slopes(spark, sf_dir).select("symbol", "horizon", F.round("p", 6).alias("p")).withColumn("family", F.lit("slopes"))
    both = T.holm(T.benjamini_hochberg(tests, "p", ["family"], ["symbol", "horizon"]), "p", ["family"], ["symbol", "horizon"])
    return rounded(both.drop("family"), "q", "holm_p")


def hac_mean(spark, sf_dir):
    return rounded(T.newey_west_mean(observations(spark, sf_dir), S, "fwd_5", 5), "mean", "se", "p")


def tail_probability(spark, sf_dir):
    z = spark.range(-40, 41).select((F.col("id") / 10).alias("z"))
    return z.select("z", F.round(normal_cdf(F.col("z")), 6).alias("cdf"))


def share_below_latest(spark, sf_dir):
    return rounded(T.share_below_latest(region_bars(spark, sf_dir), S, "close"), "latest", "share_below")


def series_agreement(spark, sf_dir):
    """How each region's scores agree with those of the first region."""
    scores = momentum_scores(spark, sf_dir).filter("score is not null")
    first = scores.filter("symbol = 'AFRICA'").select("date", F.col("score").alias("base"))
    return rounded(T.agreement(scores.filter("symbol != 'AFRICA'").join(first, "date"), S, "score", "base"), "correlation", "mean_gap", "mean_abs_gap", "same_band", "within_one_band")


def band_summary(spark, sf_dir):
    return rounded(T.by_band(observations(spark, sf_dir).withColumn("score", F.round("score", 6)), S, "score", "fwd_5"), "mean", "median")


def tail_summary(spark, sf_dir):
    parts = O.split(observations(spark, sf_dir), S, (0.6,), ("train", "test"))
    return rounded(T.tails(parts.filter("part = 'train'"), parts.filter("part = 'test'"), S, "score", "fwd_5"), "low_cut", "high_cut", "mean_low", "mean_high")


def fear_episodes(spark, sf_dir):
    rows = O.numbered(momentum_scores(spark, sf_dir), S)
    return rounded(T.episodes(rows, S, "i", F.col("score") <= 25), "mean_length")


def performance(spark, sf_dir):
    """Of a hundredth of each region's daily returns."""
    r = region_bars(spark, sf_dir).withColumn("r", (F.col("close") / F.lag("close").over(W.series(S)) - 1) / 100)
    return rounded(T.performance(r, S, "r"), "total_return", "annual_return", "volatility", "sharpe", "max_drawdown")


def forecast_comparison(spark, sf_dir):
    """Forecasts of the five-bar return: its expanding mean, and the expanding mean of the same half of the score range; both of earlier rows only."""
    obs = observations(spark, sf_dir).filter("fwd_5 is not null").withColumn("high", F.col("score") >= 50)
    past = W.series(S).rowsBetween(W.Window.unboundedPreceding, -7)
    near = W.series(["symbol", "high"]).rowsBetween(W.Window.unboundedPreceding, -7)
    rows = obs.withColumn("f0", F.avg("fwd_5").over(past)).withColumn("f1", F.avg("fwd_5").over(near)).filter("f0 is not null and f1 is not null")
    return rounded(T.forecast_comparison(rows, S, "fwd_5", "f0", "f1"), "mse_base", "mse_model", "gain", "adjusted_loss", "clark_west_p")


def world_score(spark, sf_dir):
    """The mean of the regions' scores on dates that at least four have."""
    scores = momentum_scores(spark, sf_dir).filter("score is not null")
    return scores.groupBy("date").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n")).filter("n >= 4")


def weighted_moments(spark, sf_dir):
    """Of all scores, each region weighing the same."""
    scores = momentum_scores(spark, sf_dir).filter("score is not null")
    weighed = scores.withColumn("w", 1 / F.count("*").over(W.Window.partitionBy("symbol")))
    return rounded(T.weighted_moments(weighed, "score", "w"), "mean", "scale")


def common_calendar(spark, sf_dir):
    """Mean growth since the first common date of all return flags, on their common dates."""
    bars = slot_bars(spark, sf_dir).filter("length(symbol) = 1")
    whole = bars.withColumn("n", F.count("*").over(W.Window.partitionBy("date"))).filter("n = 3")
    grown = whole.withColumn("wealth", F.col("close") / F.first("close").over(W.series(S)))
    return rounded(grown.groupBy("date").agg(F.avg("wealth").alias("wealth"), F.count("*").alias("n")), "wealth")


QUERIES = {f.__name__: f for f in (return_summary, score_correlations, hac_slope, multiplicity, hac_mean, tail_probability, share_below_latest, series_agreement, band_summary, tail_summary, fear_episodes, performance, forecast_comparison, world_score, weighted_moments, common_calendar)}


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::double * abs({x})))"
    return f"(sign({x}) * (1 - ((((1.061405429::double * {t} - 1.453152027::double) * {t} + 1.421413741::double) * {t} - 0.284496736::double) * {t} + 0.254829592::double) * {t} * exp(-({x}) * ({x}))))"


def cdf_sql(x: str) -> str:
    return f"(0.5::double * (1 + {erf_sql(f'({x} / sqrt(2.0::double))')}))"


SLOPES_SQL = OBS_SQL + f""", long as (select symbol, date, 1 as horizon, (score - 50) / 10 as x, fwd_1 as y from obs where fwd_1 is not null union all select symbol, date, 5, (score - 50) / 10, fwd_5 from obs where fwd_5 is not null union all select symbol, date, 21, (score - 50) / 10, fwd_21 from obs where fwd_21 is not null),
fit as (select symbol, horizon, count(*) as n, regr_slope(y, x) as b, avg(y) - regr_slope(y, x) * avg(x) as a, sum(x) as sx, sum(x * x) as sxx, least(count(*) - 3, greatest(any_value(horizon), floor(4 * pow(count(*) / 100.0::double, 2 / 9.0::double))))::int as bw from long group by symbol, horizon),
res as (select l.symbol, l.horizon, x, y - a - b * x as e, (y - a - b * x) * x as ex, row_number() over (partition by l.symbol, l.horizon order by date) as i, bw from long l join fit f on l.symbol = f.symbol and l.horizon = f.horizon),
now as (select symbol, horizon, sum(e * e) as m00, sum(e * ex) as m01, sum(ex * ex) as m11 from res group by 1, 2),
back as (select p.symbol, p.horizon, sum((1 - (p.i - q.i) / (p.bw + 1.0::double)) * 2 * p.e * q.e) as l00, sum((1 - (p.i - q.i) / (p.bw + 1.0::double)) * (p.e * q.ex + q.e * p.ex)) as l01, sum((1 - (p.i - q.i) / (p.bw + 1.0::double)) * 2 * p.ex * q.ex) as l11 from res p join res q on p.symbol = q.symbol and p.horizon = q.horizon and q.i between p.i - p.bw and p.i - 1 group by 1, 2),
var as (select f.symbol, f.horizon, f.n, f.bw as bandwidth, f.b as slope, sqrt(greatest(0, (pow(sx / (n * sxx - sx * sx), 2) * (m00 + l00) - 2 * sx * n / pow(n * sxx - sx * sx, 2) * (m01 + l01) + pow(n / (n * sxx - sx * sx), 2) * (m11 + l11)) * n / (n - 2))) as se
  from fit f join now using (symbol, horizon) join back using (symbol, horizon)),
tests as (select *, slope / se as z, greatest(0, least(1, 2 * (1 - {cdf_sql('abs(slope / se)')}))) as p from var)"""


def mean_sql(source: str, value: str, least: int) -> str:
    """CTEs nw_r (rows), nw (results)."""
    return f"""nw_m as (select symbol, count(*) as n, avg({value}) as m, least(count(*) - 1, greatest({least}, floor(4 * pow(count(*) / 100.0::double, 2 / 9.0::double))))::int as bw from {source} where {value} is not null group by 1),
nw_r as (select s.symbol, {value} - m as c, row_number() over (partition by s.symbol order by date) as i, bw from {source} s join nw_m on s.symbol = nw_m.symbol where {value} is not null),
nw_g as (select symbol, sum(c * c) as g0 from nw_r group by 1),
nw_l as (select p.symbol, sum(2 * (1 - (p.i - q.i) / (p.bw + 1.0::double)) * p.c * q.c) as g from nw_r p join nw_r q on p.symbol = q.symbol and q.i between p.i - p.bw and p.i - 1 group by 1),
nw as (select symbol, n, bw as bandwidth, m as mean, sqrt(greatest(0, (g0 + g) / n) / n) as se from nw_m join nw_g using (symbol) join nw_l using (symbol))"""


ORACLES = {
    "return_summary": f"with {REGION_SQL}, r as (select symbol, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars) select symbol, count(r) as n, round(avg(r), 6) as mean, round(var_samp(r), 6) as var_samp, round(var_pop(r), 6) as var_pop, round(stddev_samp(r), 6) as sd_samp, round(stddev_pop(r), 6) as sd_pop, round(median(r), 6) as median, round(quantile_cont(r, 0.05), 6) as q05, round(quantile_cont(r, 0.95), 6) as q95, round(min(r), 6) as low, round(max(r), 6) as high from r group by 1",
    "score_correlations": f"""with {OBS_SQL}, o as (select * from obs where fwd_5 is not null), k as (select *, rank() over (partition by symbol order by score) + (count(*) over (partition by symbol, score) - 1) / 2.0 as rx, rank() over (partition by symbol order by fwd_5) + (count(*) over (partition by symbol, fwd_5) - 1) / 2.0 as ry from o)
select symbol, count(*) as n, round(corr(score, fwd_5), 6) as pearson, round(corr(rx, ry), 6) as spearman, round(regr_slope(fwd_5, score), 6) as slope, round(regr_intercept(fwd_5, score), 6) as intercept from k group by 1""",
    "hac_slope": f"with {SLOPES_SQL} select symbol, n, bandwidth, round(slope, 6) as slope, round(se, 6) as se, round(z, 6) as z, round(p, 6) as p, horizon from tests",
    "multiplicity": f"""with {SLOPES_SQL}, t as (select symbol, horizon, round(p, 6) as p from tests), k as (select *, row_number() over (order by p, symbol, horizon) as r, count(*) over () as m from t)
select symbol, horizon, p, round(least(1, min(p * m / r) over (order by r desc rows unbounded preceding)), 6) as q, coalesce(r <= (select max(r) from k where p <= r / m::double * 0.05), false) as rejected,
round(least(1, max(p * (m - r + 1)) over (order by r rows unbounded preceding)), 6) as holm_p, min(p <= 0.05::double / (m - r + 1)) over (order by r rows unbounded preceding) as holm_rejected from k""",
    "hac_mean": f"with {OBS_SQL}, {mean_sql('obs', 'fwd_5', 5)} select symbol, n, bandwidth, round(mean, 6) as mean, round(se, 6) as se, round(greatest(0, least(1, 1 - {cdf_sql('mean / se')})), 6) as p from nw",
    "tail_probability": f"select z, round({cdf_sql('z')}, 6) as cdf from (select i / 10.0::double as z from range(-40, 41) t(i))",
    "share_below_latest": f"with {REGION_SQL}, l as (select symbol, max_by(close, date) as latest from region_bars group by 1) select symbol, round(latest, 6) as latest, round(100 * avg((close < latest)::int), 6) as share_below, count(*) as n from region_bars join l using (symbol) group by symbol, latest",
    "series_agreement": f"""with {SCORE_SQL}, p as (select a.symbol, a.score as a, b.score as b from scored a join scored b on a.date = b.date and b.symbol = 'AFRICA' and a.symbol <> 'AFRICA' where a.score is not null and b.score is not null),
q as (select *, (case when floor(a * 10 + 0.5) / 10 >= 75 then 4 when floor(a * 10 + 0.5) / 10 >= 56 then 3 when floor(a * 10 + 0.5) / 10 >= 45 then 2 when floor(a * 10 + 0.5) / 10 >= 25 then 1 else 0 end) - (case when floor(b * 10 + 0.5) / 10 >= 75 then 4 when floor(b * 10 + 0.5) / 10 >= 56 then 3 when floor(b * 10 + 0.5) / 10 >= 45 then 2 when floor(b * 10 + 0.5) / 10 >= 25 then 1 else 0 end) as k from p)
select symbol, count(*) as n, round(corr(a, b), 6) as correlation, round(avg(a - b), 6) as mean_gap, round(avg(abs(a - b)), 6) as mean_abs_gap, round(100 * avg((k = 0)::int), 6) as same_band, round(100 * avg((abs(k) <= 1)::int), 6) as within_one_band from q group by 1""",
    "band_summary": f"""with {OBS_SQL}, o as (select symbol, round(score, 6) as score, fwd_5 from obs), l as (select *, {label_sql('floor(score * 10 + 0.5) / 10')} as label from o),
e as (select * from (select distinct symbol from o), (values ('Extreme Fear'), ('Fear'), ('Neutral'), ('Greed'), ('Extreme Greed')) v(label))
select e.symbol, e.label, count(l.symbol) as n, round(avg(fwd_5), 6) as mean, round(median(fwd_5), 6) as median from e left join l on e.symbol = l.symbol and e.label = l.label group by 1, 2""",
    "tail_summary": f"""with {OBS_SQL}, p as (select *, row_number() over (partition by symbol order by date) - 1 < floor(count(*) over (partition by symbol) * 0.6) as train from obs),
c as (select symbol, quantile_cont(score, 0.25) as lo, quantile_cont(score, 0.75) as hi from p where train group by 1)
select symbol, round(lo, 6) as low_cut, round(hi, 6) as high_cut, count(*) filter (score <= lo) as n_low, round(avg(fwd_5) filter (score <= lo), 6) as mean_low, count(*) filter (score >= hi) as n_high, round(avg(fwd_5) filter (score >= hi), 6) as mean_high from p join c using (symbol) where not train group by symbol, lo, hi""",
    "fear_episodes": f"""with {SCORE_SQL}, h as (select symbol, i - row_number() over (partition by symbol order by date) as run from steps where score <= 25), r as (select symbol, run, count(*) as length from h group by 1, 2)
select symbol, count(*) as episodes, round(avg(length), 6) as mean_length, max(length) as longest from r group by 1""",
    "performance": f"""with {REGION_SQL}, r as (select symbol, date, (close / lag(close) over (partition by symbol order by date) - 1) / 100 as r from region_bars), w as (select *, exp(sum(ln(1 + r)) over (partition by symbol order by date)) as w from r where r is not null),
d as (select *, w / greatest(1, max(w) over (partition by symbol order by date)) - 1 as d from w)
select symbol, count(*) as n, round(exp(sum(ln(1 + r))) - 1, 6) as total_return, round(pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1, 6) as annual_return, round(stddev_samp(r) * sqrt(252), 6) as volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) as sharpe, round(min(d), 6) as max_drawdown from d group by 1""",
    "forecast_comparison": f"""with {OBS_SQL}, f as (select symbol, date, fwd_5, avg(fwd_5) over (partition by symbol order by date rows between unbounded preceding and 7 preceding) as f0, avg(fwd_5) over (partition by symbol, score >= 50 order by date rows between unbounded preceding and 7 preceding) as f1 from obs where fwd_5 is not null),
l as (select *, pow(fwd_5 - f0, 2) - pow(fwd_5 - f1, 2) + pow(f0 - f1, 2) as loss from f where f0 is not null and f1 is not null), e as (select symbol, avg(pow(fwd_5 - f0, 2)) as m0, avg(pow(fwd_5 - f1, 2)) as m1 from l group by 1), {mean_sql('l', 'loss', 5)}
select symbol, round(m0, 6) as mse_base, round(m1, 6) as mse_model, round(100 * (1 - m1 / m0), 6) as gain, round(mean, 6) as adjusted_loss, round(greatest(0, least(1, 1 - {cdf_sql('mean / se')})), 6) as clark_west_p from e join nw using (symbol)""",
    "world_score": f"with {SCORE_SQL} select date, round(avg(score), 6) as score, count(*) as n from scored where score is not null group by 1 having count(*) >= 4",
    "weighted_moments": f"with {SCORE_SQL}, w as (select score, 1.0::double / count(*) over (partition by symbol) as w from scored where score is not null) select round(sum(w * score) / sum(w), 6) as mean, round(sqrt(sum(w * score * score) / sum(w) - pow(sum(w * score) / sum(w), 2)), 6) as scale from w",
    "common_calendar": f"""with {SLOT_SQL}, c as (select *, count(*) over (partition by date) as n from slot_bars where length(symbol) = 1), g as (select date, close / first_value(close) over (partition by symbol order by date) as w from c where n = 3)
select date, round(avg(w), 6) as wealth, count(*) as n from g group by 1""",
}
