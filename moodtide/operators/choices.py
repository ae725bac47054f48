"""Which of many filings count: the last two quarters of a manager, the newest reports of a fund, and when the next ones are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL, HALF = "annual", "semi-annual"


def two_quarters(filings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, current, previous (accessions of the original filings of the latest two quarters) and problem, one row per key.

    filings: keys, form, report (date), filed, accession. Of several originals of a quarter the one filed last counts, then the one with the highest accession. An amendment
    of either quarter, a quarter without an original, or a single quarter is a problem, and then nothing is chosen: the latest quarter's problem is told first. Filings of
    other forms or without a report date are left out; a key with none but these has no row."""
    own = filings.filter(F.col("form").isin("13F-HR", "13F-HR/A") & F.col("report").isNotNull())
    # one row a quarter before anything is ordered
    quarter = own.groupBy(*keys, "report").agg(
        F.min(F.when(F.col("form") == "13F-HR/A", F.col("accession"))).alias("amended"),
        F.max(F.when(F.col("form") == "13F-HR", F.struct("filed", "accession")))["accession"].alias("base"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("report"))
    trouble = F.when(F.col("amended").isNotNull(), F.concat(F.lit("amended "), F.col("report").cast("string"))).when(F.col("base").isNull(), F.concat(F.lit("no original "), F.col("report").cast("string")))
    rows = quarter.withColumn("trouble", trouble).withColumn("place", F.row_number().over(w)).withColumn("before", F.lead(F.struct("base", "trouble", "report")).over(w)).filter("place = 1")
    problem = F.when(F.col("before").isNull(), "no earlier quarter").otherwise(F.coalesce(F.col("trouble"), F.col("before.trouble")))
    good = problem.isNull()
    return rows.select(*keys, F.when(good, F.col("base")).alias("current"), F.when(good, F.col("before.base")).alias("previous"), problem.alias("problem"))


def period_end(year: Column, month: int) -> Column:
    return F.last_day(F.make_date(year, F.lit(month), F.lit(1)))


def next_period(after: Column, month: int) -> Column:
    """The first end of that month after a date."""
    this = period_end(F.year(after), month)
    return F.when(this > after, this).otherwise(period_end(F.year(after) + 1, month))


def last_period(until: Column, month: int) -> Column:
    this = period_end(F.year(until), month)
    return F.when(this <= until, this).otherwise(period_end(F.year(until) - 1, month))


def shareholder_reports(filings: DataFrame, dates: DataFrame, keys: list[str], match: str, as_of: str, year_end: int = 6, within: int = 70) -> DataFrame:
    """Of each key the newest annual and semi-annual report (amendments count as reports) and when the next ones are due: a row for each kind.

    filings: keys, form, report (date), filed, accepted (texts, accepted may be null), accession, description, of which `match` (a regular expression, without regard to case) must be found in it. The newest has the
    latest report date, one without a date first; then the latest acceptance, then the highest accession. Without a dated report the last period that ended by as_of is due. `dates` is a calendar;
    a due date beyond it has no business day."""
    half = (year_end + 5) % 12 + 1
    kind = F.when(F.col("form").rlike(r"^N-CSR(/A)?$"), ANNUAL).when(F.col("form").rlike(r"^N-CSRS(/A)?$"), HALF)
    own = filings.withColumn("kind", kind).filter(F.col("kind").isNotNull() & F.coalesce(F.col("description"), F.lit("")).rlike(f"(?i){match}"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc_nulls_first("report"), F.desc(F.coalesce("accepted", "filed")), F.desc("accession"))
    newest = own.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*keys, "kind", "accession", "report", F.col("form").endswith("/A").alias("amends"))
    wanted = filings.select(*keys).distinct().withColumn("kind", F.explode(F.array(F.lit(ANNUAL), F.lit(HALF))))
    now = F.lit(as_of).cast("date")
    end = lambda m: F.when(F.col("report").isNotNull(), next_period(F.col("report"), m)).otherwise(last_period(now, m))
    rows = wanted.join(newest, [*keys, "kind"], "left").withColumn("period_end", F.when(F.col("kind") == ANNUAL, end(year_end)).otherwise(end(half))).withColumn("due_by", F.date_add("period_end", within))
    return rows.join(dates.select(F.col("date").alias("due_by"), F.col("business_day").alias("due")), "due_by", "left").withColumn("rolled", F.col("due") != F.col("due_by"))
