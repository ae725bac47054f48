"""Choosing among observations, and holding them against what is declared or expected of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def report_order(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Fund reports and their amendments in the order in which they are tried: latest report first, amendments before originals, then the latest acceptance.

    Needs form, report (text), filed, accepted (may be null) and document (may be a path, or null). Other forms and reports without a whole date go.
    """
    own = filings.filter(F.col("form").isin("NPORT-P", "NPORT-P/A") & F.col("report").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    name = F.element_at(F.split(F.coalesce("document", F.lit("")), "/"), -1)
    own = own.withColumn("amends", F.col("form").endswith("/A")).withColumn("document", F.when(name == "", "primary_doc.xml").otherwise(name))
    order = Window.partitionBy(*keys).orderBy(F.desc("report"), F.desc("amends"), F.desc(F.coalesce("accepted", "filed")), "accession")
    return own.withColumn("place", F.row_number().over(order))


def total_mismatches(rows: DataFrame, declared: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tables whose number of rows or sum of values isn't the declared one (declared_n, declared_total); a table without rows counts as empty."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    both = declared.join(sums, keys, "left").fillna(0, ["n", "total"])
    wrong = F.array_compact(F.array(F.when(F.col("n") != F.col("declared_n"), "entries"), F.when(F.col("total") != F.col("declared_total"), "value")))
    return both.withColumn("problem", F.array_join(wrong, " and ")).filter("problem <> ''")


def newest_observation(daily: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the newer of the daily observation and the last one in the history; on equal dates the daily one.

    change is that of the source taken: the daily row's own, or the last against the last but one in percent. A row without date or value counts as absent.
    """
    usable = F.col("date").isNotNull() & F.col("nav").isNotNull() & ~F.isnan("nav")
    back = Window.partitionBy(*keys).orderBy(F.desc("date"))
    last = history.filter(usable).withColumn("before", F.lead("nav").over(back)).withColumn("place", F.row_number().over(back)).filter("place = 1")
    change = F.when(F.col("before") != 0, (F.col("nav") / F.col("before") - 1) * 100)
    last = last.select(*keys, F.col("date").alias("h_date"), F.col("nav").alias("h_nav"), change.alias("h_change"))
    both = daily.filter(usable).select(*keys, "date", "nav", "change").join(last, keys, "full")
    old = F.col("h_date").isNotNull() & (F.col("date").isNull() | (F.col("h_date") > F.col("date")))
    pick = lambda c: F.when(old, F.col(f"h_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, pick("date"), pick("nav"), pick("change"), F.when(old, "historical").otherwise("daily").alias("source"), F.col("date").alias("daily_date"), (old & F.col("date").isNotNull()).alias("lags"))


def freshness(file_date: Column, check_date: Column, next_session: Column, most: int = 5) -> Column:
    """What a file's date says on the day of a check: fresh, next (dated to the next session), future or stale."""
    age = F.datediff(check_date, file_date)
    return F.when((age < 0) & (file_date == next_session), "next").when(age < 0, "future").when(age > most, "stale").otherwise("fresh")


def quotes(bars: DataFrame, keys: list[str]) -> DataFrame:
    """The last price, and as previous close the last but one of the valid closes, null if there is only one."""
    back = Window.partitionBy(*keys).orderBy(F.desc("date"))
    price = bars.withColumn("place", F.row_number().over(back)).filter("place = 1").select(*keys, F.col("price"))
    valid = bars.filter(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("place", F.row_number().over(back)).filter("place = 2")
    return price.join(valid.select(*keys, F.col("close").alias("previous")), keys, "left")


def sign_summary(blocks: DataFrame, keys: list[str], coefficient: str) -> DataFrame:
    """How many blocks have a positive, a negative or no slope (null: none), and the sign that most of them have; null if neither leads."""
    sign = F.signum(F.coalesce(F.col(coefficient), F.lit(0.0)))
    count = lambda s, name: F.count(F.when(sign == s, 1)).alias(name)
    out = blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), count(1, "positive"), count(-1, "negative"), count(0, "zero"))
    most = F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative")
    share = F.when(most.isNull(), 0.0).otherwise(F.greatest("positive", "negative") / F.col("blocks"))
    return out.withColumn("dominant", most).withColumn("dominant_share", share)


def carried(components: DataFrame, keys: list[str], market: str, component: str) -> DataFrame:
    """Per key the components older than the market's date (as_of before date), as sorted texts market.component@date."""
    old = components.filter("as_of < date").withColumn("t", F.concat(F.col(market), F.lit("."), F.col(component), F.lit("@"), F.date_format("as_of", "yyyy-MM-dd")))
    return old.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("carried"))


def sub_periods(bars: DataFrame, keys: list[str], starts: list[str]) -> DataFrame:
    """Growth within each of the periods that begin on the given dates, over returns that end in it; what lies before the first start is period 0."""
    which = sum(((F.col("date") >= F.lit(s).cast("date")).cast("int") for s in starts), F.lit(0))
    steps = bars.withColumn("r", W.log_return(F.col("close"), keys)).filter("r is not null").withColumn("period", which)
    return steps.groupBy(*keys, "period").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.exp(F.sum("r")).alias("growth"), F.stddev_samp("r").alias("sd"))


def path_summary(path: DataFrame, keys: list[str], per_year: float) -> DataFrame:
    """Intervals, factor, annual log return, volatility and deepest fall of paths of wealth by index; valid tells whether the indices are
    consecutive and all wealth is above zero. Paths of one row have no intervals and null figures."""
    w = W.series(keys, "index")
    up_to_now = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = path.withColumn("r", F.try_divide(F.col("wealth"), F.lag("wealth").over(w)) - 1).withColumn("step", F.col("index") - F.lag("index").over(w))
    steps = steps.withColumn("fall", 1 - F.try_divide(F.col("wealth"), F.max("wealth").over(up_to_now)))
    n = F.count("*") - 1
    factor = F.try_divide(F.max_by("wealth", "index"), F.min_by("wealth", "index"))
    out = steps.groupBy(*keys).agg(
        F.min("index").alias("first"), F.max("index").alias("last"), n.alias("intervals"), F.when(n > 0, factor).alias("factor"), F.when(n > 0, F.coalesce(F.stddev_samp("r"), F.lit(0.0)) * math.sqrt(per_year)).alias("volatility"),
        F.max("fall").alias("drawdown"), F.every(F.coalesce(F.col("step") == 1, F.lit(True)) & F.coalesce(F.col("wealth") > 0, F.lit(False))).alias("valid"),
    )
    return out.withColumn("annual_log", F.when(F.col("factor") > 0, F.ln("factor") * per_year / F.col("intervals")))
