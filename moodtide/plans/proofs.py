"""Verified entries, guarded documents, comparison of runs, tails and identifiability over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numbers import normal_survival
from ..operators import documents as N, models as M, runs as X
from ..operators.lineage import folder
from ..sources import verified as V
from ..sources.bars import cents, table
from .forecasts import learner_rows
from .outcomes import SCORE_SQL
from .sentiment import rounded

ENTRY = "schema string, entryDate string, previousSha256 string, n bigint, total bigint"


def _stored_entries(spark, sf_dir):
    """A store of one entry a month: documents with the orders' number and total, each with the digest of the one before, and their sidecars; some of them spoilt by
    their number in the store. Returns its folder."""
    months = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum(cents(F.col("o_totalprice"))).alias("total"))
    listed = months.agg(F.array_sort(F.collect_list(F.struct("name", "n", "total"))).alias("m"))  # an entry a month
    start = F.struct(F.lit("genesis").alias("last"), F.array().cast("array<struct<name: string, text: string, digest: string>>").alias("out"))

    def add(acc, x):
        k = F.size(acc["out"])
        version = F.when(k % 17 == 7, "entry-v0").otherwise("entry-v1")
        date = F.when(k % 19 == 9, "1990-01-01").otherwise(x["name"])
        text = F.to_json(F.struct(version.alias("schema"), date.alias("entryDate"), acc["last"].alias("previousSha256"), x["n"].alias("n"), x["total"].alias("total")))
        digest = F.sha2(F.concat(text, F.lit("\n")), 256)  # as a line of a text file
        return F.struct(digest.alias("last"), F.concat(acc["out"], F.array(F.struct(x["name"].alias("name"), text.alias("text"), digest.alias("digest")))).alias("out"))

    rows = listed.select(F.posexplode(F.aggregate("m", start, add)["out"]).alias("k", "e"))
    spoilt = F.concat(F.col("e.text"), F.when(F.col("k") % 11 == 3, " ").otherwise(""))
    documents = rows.select(F.lit("document").alias("kind"), F.col("e.name").alias("entry"), spoilt.alias("value"))
    sidecars = rows.filter("k % 13 <> 5").select(F.lit("sha256").alias("kind"), F.col("e.name").alias("entry"), F.concat("e.digest", F.lit("  "), "e.name").alias("value"))
    path = f"{folder(spark)}/entries-{uuid.uuid4().hex}"
    documents.unionByName(sidecars).repartition("kind", "entry").write.partitionBy("kind", "entry").text(path)
    return path


def entry_problems(spark, sf_dir):
    """What is wrong with a store of monthly entries."""
    found = V.verified(V.files(spark, _stored_entries(spark, sf_dir)))
    return V.problems(found, ENTRY, "entry-v1", genesis="genesis", most_days=31)


def verified_entries(spark, sf_dir):
    """The entries that are what their sidecars say and of the version that is read."""
    found = V.verified(V.files(spark, _stored_entries(spark, sf_dir)))
    return V.read_verified(found, ENTRY, "entry-v1").select("name", "entryDate", "n", "total")


def _nested(spark, sf_dir):
    """A document a customer with its orders, in which fields with forbidden names stand at depths that depend on the order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    inner = F.concat(F.lit('{"key":'), k.cast("string"), F.when(k % 7 == 0, ',"signal":1').otherwise(""), F.lit(',"price":'), F.format_string("%.2f", F.col("o_totalprice")), F.lit("}"))
    deep = F.when(k % 5 == 0, F.concat(F.lit('{"z":{"list":['), inner, F.lit(',{"result":null}]},"a":-0.0}'))).otherwise(inner)
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), deep.alias("d")))).alias("l"))
    text = F.concat(F.lit('{"orders":['), F.array_join(F.transform("l", lambda x: x["d"]), ", "), F.lit('],"customer":'), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 50 == 1, ',"prototype":{}').otherwise(""), F.when(F.col("o_custkey") % 50 != 2, F.lit("}")).otherwise(""))
    return N.nodes(lists.select("o_custkey", text.alias("text")), ["o_custkey"])


def forbidden_names(spark, sf_dir):
    """Fields of nested documents that data must not have, with their paths."""
    return N.forbidden(_nested(spark, sf_dir), ["o_custkey"], ("signal", "result"))


def canonical_documents(spark, sf_dir):
    """Digests of nested documents in canonical text, or why there is none."""
    return N.canonical(_nested(spark, sf_dir), ["o_custkey"]).drop("text")


def _two_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", cents(F.col("o_totalprice")).alias("c"), F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderpriority")).alias("p"))
    k = F.col("o_orderkey")
    changed = rows.filter(k % 5003 != 11).withColumn("c", F.when(k % 4001 == 7, F.col("c") + 1).otherwise(F.col("c")))
    top = folder(spark)
    paths = [f"{top}/run-{uuid.uuid4().hex}" for _ in range(2)]
    X.save_run(rows, paths[0])
    X.save_run(changed.unionByName(rows.filter(k % 6007 == 3)), paths[1])
    return paths


def run_differences(spark, sf_dir):
    """The rows in which two runs differ: some changed, some lost, some repeated."""
    return X.differences(spark, *_two_runs(spark, sf_dir))


def normal_tails(spark, sf_dir):
    """The logarithm of the probability beyond 0 to 36 deviations."""
    z = F.pmod("o_orderkey", F.lit(3600)) / 100
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", z.alias("z"), F.log(normal_survival(z)).alias("log_p")), "log_p")


def identifiability(spark, sf_dir):
    """Whether trend says more than return and volatility, for each pair of a region with Europe; in one case it is made of them, in one it never changes, in one Europe is missing."""
    rows = learner_rows(spark, sf_dir).select("symbol", "date", "log1", "vol20", "trend").dropna()
    pairs = rows.filter("symbol <> 'EUROPE'").withColumn("pair", F.col("symbol"))
    names = pairs.select("pair").distinct().filter("pair <> 'ASIA'")
    both = pairs.unionByName(rows.filter("symbol = 'EUROPE'").join(names))
    made = F.when(F.col("pair") == "AFRICA", 2 * F.col("log1") - 3 * F.col("vol20")).when(F.col("pair") == "AMERICA", 1.0).otherwise(F.col("trend"))
    return rounded(M.identifiability(both.withColumn("trend", made), ["pair"], "symbol", ["log1", "vol20"], "trend", 2), "residual_variance")


QUERIES = {f.__name__: f for f in (entry_problems, verified_entries, forbidden_names, canonical_documents, run_differences, normal_tails, identifiability)}

_MONTHS = "m as (select *, row_number() over (order by name) - 1 as k from (select date_trunc('month', o_orderdate)::date::varchar as name, count(*) as n, sum(round(o_totalprice * 100)::bigint)::bigint as total from orders group by 1))"
_INNER = """'{"key":' || k || case when k % 7 = 0 then ',"signal":1' else '' end || ',"price":' || price || '}'"""
_CANON = """'{"key":' || k || ',"price":' || plain || case when k % 7 = 0 then ',"signal":1' else '' end || '}'"""
ORACLES = {
    "entry_problems": f"""with {_MONTHS} select name, 'no sidecar' as problem from m where k % 13 = 5 union all select name, 'differs' from m where k % 11 = 3 and k % 13 <> 5 union all select name, 'version' from m where k % 17 = 7
union all select name, 'date' from m where k % 19 = 9 union all select name, 'chain' from m where k > 0 and (k - 1) % 11 = 3""",
    "verified_entries": f"with {_MONTHS} select name, case when k % 19 = 9 then '1990-01-01' else name end as \"entryDate\", n, total from m where k % 13 <> 5 and k % 11 <> 3 and k % 17 <> 7",
    "forbidden_names": """with o as (select o_custkey, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders where o_custkey % 50 <> 2)
select o_custkey, '$.orders[' || i || ']' || case when k % 5 = 0 then '.z.list[0].signal' else '.signal' end as path, 'signal' as name from o where k % 7 = 0 union all select o_custkey, '$.orders[' || i || '].z.list[1].result', 'result' from o where k % 5 = 0""",
    "canonical_documents": f"""with o as (select o_custkey, o_orderkey as k, regexp_replace(regexp_replace(format('{{:.2f}}', o_totalprice::double), '0+$', ''), '\\.$', '') as plain from orders),
d as (select o_custkey, '{{"customer":' || o_custkey || ',"orders":[' || string_agg(case when k % 5 = 0 then '{{"a":0,"z":{{"list":[' || {_CANON} || ',{{"result":null}}]}}}}' else {_CANON} end, ',' order by k) || ']}}' as text from o group by o_custkey)
select o_custkey, case when o_custkey % 50 not in (1, 2) then sha256(text) end as digest, case o_custkey % 50 when 1 then 'dangerous name' when 2 then 'no JSON' end as problem from d""",
    "run_differences": """with a as (select o_orderkey, o_custkey, round(o_totalprice * 100)::bigint as c, case when o_orderkey % 9 <> 0 then o_orderpriority end as p from orders),
b as (select o_orderkey, o_custkey, c + (o_orderkey % 4001 = 7)::int as c, p from a where o_orderkey % 5003 <> 11 union all select * from a where o_orderkey % 6007 = 3),
u as (select *, 1 as l, 0 as r from a union all select *, 0, 1 from b) select o_orderkey, o_custkey, c, p, sum(l)::bigint as left, sum(r)::bigint as right from u group by 1, 2, 3, 4 having sum(l) <> sum(r)""",
    "normal_tails": """with o as (select o_orderkey, o_orderkey % 3600 / 100.0::double as z, o_orderkey % 3600 / 100.0::double / sqrt(2.0::double) as x from orders),
t as (select o_orderkey, z, x, case when x < 1 then ln((1 - 2 / sqrt(pi()) * list_sum([case when k % 2 = 0 then 1 else -1 end * pow(x, 2 * k + 1) / (gamma(k + 1.0::double) * (2 * k + 1)) for k in range(30)])) / 2)
  else -z * z / 2 - ln(2 * sqrt(pi()) * list_reduce([(201 - k)::double for k in range(1, 201)], lambda f, k: x + k / 2 / f, x)) end as log_p from o)
select o_orderkey, z, round(log_p, 6) as log_p from t""",
    "identifiability": f"""with {SCORE_SQL}, f as (select symbol, date, ln(close / lag(close) over w) as a, case when count(r) over v = 20 then stddev_pop(r) over v end as b, case when i >= 124 then ln(close / avg(close) over (partition by symbol order by date rows 124 preceding)) end as y
  from steps window w as (partition by symbol order by date), v as (partition by symbol order by date rows 19 preceding)),
g as (select * from f where a is not null and b is not null and y is not null), n as (select unnest(['AFRICA', 'AMERICA', 'MIDDLE EAST']) as pair), h as (select symbol as pair, * from g where symbol <> 'EUROPE' union all select pair, g.* from n, g where symbol = 'EUROPE'),
k as (select pair, symbol, a, b, case pair when 'AFRICA' then 2 * a - 3 * b when 'AMERICA' then 1 else y end as y from h),
m as (select pair, symbol, count(*) as n, avg(a) as a, avg(b) as b, avg(y) as y, avg(a * a) as aa, avg(a * b) as ab, avg(b * b) as bb, avg(a * y) as ay, avg(b * y) as "by", avg(y * y) as yy from k group by 1, 2),
s as (select pair, sum(n)::bigint as rows, avg(aa) - pow(avg(a), 2) as aa, avg(bb) - pow(avg(b), 2) as bb, avg(yy) - pow(avg(y), 2) as yy, avg(ab) - avg(a) * avg(b) as ab, avg(ay) - avg(a) * avg(y) as ay, avg("by") - avg(b) * avg(y) as "by" from m group by 1),
c as (select pair, rows, ab / sqrt(aa * bb) as ab, ay / sqrt(aa * greatest(yy, 1e-30)) as ay, "by" / sqrt(bb * greatest(yy, 1e-30)) as "by" from s)
select pair, rows, case pair when 'ASIA' then 'weights' when 'AMERICA' then 'preprocessing' when 'AFRICA' then 'residual variance' end as stage,
  case when pair not in ('ASIA', 'AMERICA') then round(greatest(0, 1 - (ay * ay + "by" * "by" - 2 * ay * "by" * ab) / (1 - ab * ab)), 6) end as residual_variance from c""",
}
