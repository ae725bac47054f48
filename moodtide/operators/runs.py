"""Comparing two runs: digests of multisets of rows in a tree of hash buckets.

A saved run is dealt into buckets by a hash of its rows; each bucket, and each group of buckets above it, has a digest that doesn't depend on the order of rows: how many there are, two sums of
64-bit hashes, and their exclusive or. Runs are equal if their roots are; else only the buckets whose digests differ are read, from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FAN = 256, 16


def row_hash(columns: list[str], salt: int = 0) -> Column:
    """64 bits of a row; nulls and places count, so that a value can't move to the next column."""
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(salt), *parts)


def digests(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, n, a, b, x: the digest of each group of rows."""
    h = rows.select(*by, row_hash(columns).alias("_a"), row_hash(columns, 1).alias("_b"))
    return h.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("b"), F.bit_xor("_a").alias("x"))


def save_run(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes rows by bucket, and the digests of buckets, beneath folder. Maps have no order and can't be compared: columns must not hold them."""
    columns = rows.columns
    dealt = rows.withColumn("__bucket", F.pmod(row_hash(columns), F.lit(buckets)).cast("int"))
    dealt.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/rows")
    saved = rows.sparkSession.read.parquet(f"{folder}/rows")
    digests(saved, columns, ["__bucket"]).write.parquet(f"{folder}/digests")


def tree(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """level, node, n, a, b, x: digests of groups of `fan` buckets, of groups of those, up to the root (level 0 is that of buckets). Digests of a group are sums, so no row is read."""
    out = level = leaves.select(F.lit(0).alias("level"), F.col("__bucket").alias("node"), "n", "a", "b", "x")
    depth, width = 0, BUCKETS
    while width > 1:
        depth, width = depth + 1, -(-width // fan)
        level = level.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"), F.bit_xor("x").alias("x")).select(F.lit(depth).alias("level"), "node", "n", "a", "b", "x")
        out = out.unionByName(level)
    return out


def unequal(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """on: the groups whose digests differ, or that only one side has."""
    values = ["n", "a", "b", "x"]
    both = first.select(*on, F.struct(*values).alias("l")).join(second.select(*on, F.struct(*values).alias("r")), on, "full")
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(*on)


def differences(spark: SparkSession, first: str, second: str) -> DataFrame:
    """The rows that one run has more often than the other, with `left` and `right`: how often. Only the files of unequal buckets are read; their numbers, at most
    as many as there are buckets, go to the driver."""
    d = [spark.read.parquet(f"{f}/digests") for f in (first, second)]
    open_ = sorted(r[0] for r in unequal(*d, ["__bucket"]).collect())
    sides = [spark.read.parquet(f"{f}/rows").filter(F.col("__bucket").isin(open_)).drop("__bucket") for f in (first, second)]
    columns = sides[0].columns
    key = [row_hash(columns).alias("_a"), row_hash(columns, 1).alias("_b")]
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    counted = [s.select(*key, row.alias("row")).groupBy("_a", "_b").agg(F.first("row").alias("row"), F.count("*").alias("n")) for s in sides]
    both = counted[0].select("_a", "_b", F.col("row").alias("r1"), F.col("n").alias("left")).join(counted[1].select("_a", "_b", F.col("row").alias("r2"), F.col("n").alias("right")), ["_a", "_b"], "full")
    out = both.select(F.coalesce("r1", "r2").alias("row"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right")).filter("left <> right")
    return out.select("row.*", "left", "right")
