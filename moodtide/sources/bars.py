"""Daily price bars, and their derivation from order lines for want of market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: Column) -> Column:
    """Whole cents, so that sums don't depend on the order in which tasks deliver them."""
    return F.round(price * 100).cast("long")


def region_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (a region), date, close: the mean price of the region's order lines shipped that day."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", cents(F.col("l_extendedprice")).alias("c"), F.to_date("l_shipdate").alias("date"))
    # summed by supplier first, so that the joins see one row per supplier and day
    sums = lines.groupBy("l_suppkey", "date").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    by_day = sums.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("r_name").alias("symbol"), "date")
    return by_day.agg((F.sum("s") / F.sum("n") / 100).alias("close"))


def slot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (return flag, or line status and return flag), date, close."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", cents(F.col("l_extendedprice")).alias("c"), F.to_date("l_shipdate").alias("date"))
    fine = lines.groupBy("l_returnflag", "l_linestatus", "date").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    both = fine.select(F.explode(F.array("l_returnflag", F.concat("l_linestatus", "l_returnflag"))).alias("symbol"), "date", "s", "n")
    return both.groupBy("symbol", "date").agg((F.sum("s") / F.sum("n") / 100).alias("close"))


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_bars(spark, sf_dir).unionByName(slot_bars(spark, sf_dir))


#: Which bars play which part in each market's composite.
SLOTS = {"bond": "A", "hy": "N", "ig": "R", "small": "ON", "large": "FR"}

REGION_SQL = """region_bars as (
  select r_name as symbol, l_shipdate::date as date, sum(round(l_extendedprice * 100)::bigint)::double / count(*) / 100 as close
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by 1, 2)"""
SLOT_SQL = """slot_bars as (
  select symbol, l_shipdate::date as date, sum(round(l_extendedprice * 100)::bigint)::double / count(*) / 100 as close
  from (select l_returnflag as symbol, l_shipdate, l_extendedprice from lineitem
        union all select l_linestatus || l_returnflag, l_shipdate, l_extendedprice from lineitem) group by 1, 2)"""
