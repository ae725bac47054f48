"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialised, materialise

#: Into how many parts the rows of one key are dealt at most.
PARTS = 64


def joined_by_parts(rows: DataFrame, values: DataFrame, key: str | list[str], spread: Column, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with values, which has one row per key, without bringing all rows of a key together: they are dealt into parts by a hash of
    `spread`, and the key's value goes to each of its parts, of which it has PARTS or as many as rows."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    parts = dealt.select(*keys, "__part").distinct().join(values, keys)
    return dealt.join(parts, [*keys, "__part"], how).drop("__part")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of a link; links go both ways, loops count as nodes.

    Alternates large-star and small-star (Kiveris et al., 2014) until no link changes. Every round links each
    node to the least of its neighbours, by an aggregate with partial sums and a join that deals the neighbours of a node into parts; the
    number of links never grows, and rounds grow with the logarithm of the number of nodes. Each round's links are written to the shared folder.
    """
    spark: SparkSession = links.sparkSession
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialise(edges.filter(u != v))
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined_by_parts(both, least, "u", v).filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined_by_parts(large, least, "u", v).select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).distinct()
        after = materialise(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialised(now)
        now = after
        if mark == before:
            break
        before = mark
    out = nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("component"))
