"""Filings chosen among those of customers, and the days by which the next ones are due."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as C, choices as O
from ..sources.bars import table
from .disclosure import CAL_SQL

AS_OF = "1998-08-15"
FORMS = ("N-CSR", "N-CSRS", "N-CSR/A", "10-K", "N-CSRS", "N-CSRS/A", "N-CSR", "N-CSRX")


def _calendar(spark):
    return C.calendar(spark, "1990-12-01", "2004-12-31")


def chosen_quarters(spark, sf_dir):
    """Orders as filings of their customer for the quarter before; some amend, some are of another form, some without a date."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    form = F.when(k % 13 == 0, "13F-HR/A").when(k % 7 == 0, "13F-NT").otherwise("13F-HR")
    report = F.when(k % 29 != 0, F.date_sub(F.trunc(day, "quarter"), 1))
    filings = table(spark, sf_dir, "orders").select("o_custkey", form.alias("form"), report.alias("report"), day.alias("filed"), k.alias("accession"))
    return O.two_quarters(filings, ["o_custkey"])


def shareholder_reports(spark, sf_dir):
    """Orders as reports of the funds of a customer, some of other funds, some without dates or times."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    report = F.when(k % 19 != 0, F.date_sub(F.trunc(day, "quarter"), 1))
    filings = table(spark, sf_dir, "orders").select(
        "o_custkey", form.alias("form"), report.alias("report"), day.cast("string").alias("filed"), F.when(k % 5 != 0, F.concat(day.cast("string"), F.lit("T16"))).alias("accepted"), k.alias("accession"),
        F.when(k % 17 == 0, None).when(k % 4 == 0, "Another trust").otherwise(F.concat(F.lit("Growth FUND "), "o_custkey")).alias("description"),
    )
    return O.shareholder_reports(filings, _calendar(spark), ["o_custkey"], "growth fund", AS_OF).select("o_custkey", "kind", "accession", "amends", "period_end", "due_by", "due", "rolled")


def filing_opportunities(spark, sf_dir):
    """For each date of an order the next quarter's end, and the days by which its holdings (45 days) and its fund's report (60 days) are due, with what moves them."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("report")).filter("report is not null").distinct()
    dates = C.with_reasons(_calendar(spark))
    rows = days.withColumn("after", F.explode(F.array(F.lit(45), F.lit(60)))).withColumn("quarter_end", C.quarter_end_after(F.col("report"))).withColumn("due", F.date_add("quarter_end", F.col("after")))
    return rows.join(dates.select(F.col("date").alias("due"), F.col("business_day").alias("deadline"), "reason"), "due", "left")


QUERIES = {f.__name__: f for f in (chosen_quarters, shareholder_reports, filing_opportunities)}

_CAL = CAL_SQL.replace("'1994-12-01'", "'1990-12-01'")
ORACLES = {
    "chosen_quarters": """with f as (select o_custkey, o_orderkey as k, o_orderdate::date as filed, (date_trunc('quarter', o_orderdate) - interval 1 day)::date as report, case when o_orderkey % 13 = 0 then 'A' else 'B' end as form from orders where (o_orderkey % 13 = 0 or o_orderkey % 7 <> 0) and o_orderkey % 29 <> 0),
q as (select o_custkey, report, count(*) filter (form = 'A') as amended, arg_max(k, (filed, k)) filter (form = 'B') as base from f group by 1, 2),
t as (select *, case when amended > 0 then 'amended ' || report when base is null then 'no original ' || report end as trouble, row_number() over (partition by o_custkey order by report desc) as place from q),
x as (select a.o_custkey, a.base as current, b.base as previous, case when b.report is null then 'no earlier quarter' else coalesce(a.trouble, b.trouble) end as problem from t a left join t b on a.o_custkey = b.o_custkey and b.place = 2 where a.place = 1)
select o_custkey, case when problem is null then current end as current, case when problem is null then previous end as previous, problem from x""",
    "shareholder_reports": f"""with {_CAL}, f as (select o_custkey, o_orderkey as k, [{', '.join(f"'{f}'" for f in FORMS)}][o_orderkey % {len(FORMS)} + 1] as form, case when o_orderkey % 19 <> 0 then (date_trunc('quarter', o_orderdate) - interval 1 day)::date end as report,
  o_orderdate::date || case when o_orderkey % 5 <> 0 then 'T16' else '' end as stamp from orders where o_orderkey % 4 <> 0 and o_orderkey % 17 <> 0),
n as (select *, case when form like 'N-CSRS%' then 'semi-annual' else 'annual' end as kind from f where form in ('N-CSR', 'N-CSR/A', 'N-CSRS', 'N-CSRS/A') qualify row_number() over (partition by o_custkey, kind order by report desc nulls first, stamp desc, k desc) = 1),
w as (select * from (select distinct o_custkey from orders), (values ('annual'), ('semi-annual')) v(kind)), j as (select w.*, k as accession, form like '%/A' as amends, report from w left join n using (o_custkey, kind)),
e as (select date, case when month(date) = 6 then 'annual' else 'semi-annual' end as kind from cal where date = last_day(date) and month(date) in (6, 12)),
p as (select j.*, case when report is not null then (select min(date) from e where e.kind = j.kind and date > report) else (select max(date) from e where e.kind = j.kind and date <= date '{AS_OF}') end as period_end from j),
d as (select distinct period_end, (select min(date) from cal where date >= period_end + 70 and not weekend and holiday is null) as due from p)
select o_custkey, kind, accession, amends, period_end, period_end + 70 as due_by, due, due <> period_end + 70 as rolled from p join d using (period_end)""",
    "filing_opportunities": f"""with {_CAL}, q as (select distinct o_orderdate::date as report, "after", (date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day)::date as q0 from orders, (values (45), (60)) v("after")),
e as (select report, "after", case when q0 > report then q0 else (date_trunc('quarter', report) + interval 6 month - interval 1 day)::date end as quarter_end from q), u as (select *, quarter_end + "after" as due from e),
d as (select due, (select min(date) from cal where date >= due and not weekend and holiday is null) as deadline from (select distinct due from u)),
r as (select due, deadline, count(*) filter (weekend) as ends, any_value(dayname(date)) filter (weekend) as day, string_agg(distinct holiday, ' and ') filter (not weekend) as named from d left join cal on date >= due and date < deadline group by 1, 2)
select u.*, deadline, case when ends > 0 then case when ends > 1 then 'a weekend' else 'a ' || day end || coalesce(', and ' || named || ' the next working day', '') else named end as reason from u join r using (due)""",
}
