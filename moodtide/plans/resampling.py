"""How sure the returns after days of fear or greed differ from those after all days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resampling as R, windows as W
from .trading import DAMPED, S, scored

REPS, HORIZON = 500, 21


def bucket_confidence(spark, sf_dir):
    """Returns over 21 bars from the next close after scores of at most 25 and of at least 75, against those after all scores."""
    w = W.series(S)
    bars = scored(spark, sf_dir).withColumn("forward", F.lead("close", 1 + HORIZON).over(w) / F.lead("close", 1).over(w) - 1).filter("score is not null and forward is not null")
    shown = F.floor(F.floor(F.col("score") * 10 + 0.5) / 10 + 0.5)
    two = bars.withColumn("t", F.explode(F.array(F.struct(F.lit("fear").alias("bucket_name"), (shown <= 25).alias("inside")), F.struct(F.lit("greed").alias("bucket_name"), (shown >= 75).alias("inside"))))).select(*S, "date", "forward", "t.*")
    out = R.bucket_confidence(two, [*S, "bucket_name"], "date", "forward", "inside", REPS, HORIZON, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("difference", "low", "high", "p")})


QUERIES = {"bucket_confidence": bucket_confidence}

_JUMPS = ", ".join(f"{{'a': {a}::hugeint, 'c': {c}::hugeint}}" for a, c in R.jumps()[:24])
ORACLES = {
    "bucket_confidence": f"""with {DAMPED}, f as (select *, lead(close, {1 + HORIZON}) over w / lead(close) over w - 1 as x from b window w as (partition by symbol order by date)),
s as (select symbol, bucket_name, date, x, case when bucket_name = 'fear' then shown <= 25 else shown >= 75 end as inside from f, (values ('fear'), ('greed')) v(bucket_name) where score is not null and x is not null),
i as (select *, row_number() over (partition by symbol, bucket_name order by date) - 1 as i, count(*) over (partition by symbol, bucket_name) as n from s),
z as (select symbol, bucket_name, count(*) as n, count(*) filter (inside) as bucket, avg(x) filter (inside) - avg(x) as difference, least(count(*), {HORIZON + 3}) as block from i group by 1, 2),
j as (select [{_JUMPS}] as jumps), dk as (select distinct rep * ceil(n / block)::bigint + b + 1 as k from z, range({REPS}) r(rep), range(1000) q(b) where b < ceil(n / block)),
st as (select k, list_reduce([{R.SEED}::hugeint] || [e::hugeint for e in range(24) if (k >> e) & 1 = 1], lambda s, e: (s * jumps[(e + 1)::bigint].a + jumps[(e + 1)::bigint].c) % 4294967296) as state from dk, j),
d as (select symbol, bucket_name, n, rep, floor(state::double / 4294967296 * (n - block + 1))::bigint as start, least(block, n - b * block) as len from z, range({REPS}) r(rep), range(1000) q(b), st where b < ceil(n / block) and st.k = rep * ceil(n / block)::bigint + b + 1),
u as (select d.symbol, d.bucket_name, rep, d.n, sum(x) as a, sum(x) filter (inside) as p, count(*) filter (inside) as k from d join i on i.symbol = d.symbol and i.bucket_name = d.bucket_name and i.i >= start and i.i < start + len group by 1, 2, 3, 4),
v as (select symbol, bucket_name, p / k - a / n as diff from u where k >= 5), o as (select *, row_number() over (partition by symbol, bucket_name order by diff) - 1 as r, count(*) over (partition by symbol, bucket_name) as m from v),
c as (select symbol, bucket_name, count(*) as valid, max(diff) filter (r = floor(m * 0.025::double)) as low, max(diff) filter (r = floor(m * 0.975::double)) as high, least(1, 2 * least(count(*) filter (diff <= 0) / count(*)::double, count(*) filter (diff >= 0) / count(*)::double)) as p from o group by 1, 2)
select symbol, bucket_name, n, bucket, round(difference, 6) as difference, case when valid >= {REPS / 2} then round(low, 6) end as low, case when valid >= {REPS / 2} then round(high, 6) end as high, case when valid >= {REPS / 2} then round(p, 6) end as p, coalesce(valid, 0) as valid from z left join c using (symbol, bucket_name)""",
}
