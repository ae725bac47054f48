"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised and projected on random directions; each of TABLES tables has PROJECTIONS of them, and
a bucket is the tuple of the projections' quantised values (width WIDTH) with label and dimension. Rows of the same bucket in any table
are compared by their exact cosine in double precision. For vectors exactly at the threshold 0.93 one quantised
projection agrees with probability 0.80, hence a table with 0.069 and one of 40 tables with 0.94; for closer vectors that
rises fast (0.995 at cosine 0.95). Unrelated vectors share a bucket of one table once in 80,000 pairs.

Equal vectors of a label are one entry of the index with a count, so copies cost nothing. Entries stand in blocks of BLOCK, in the order of their buckets. Entries that share a bucket in any
table make their blocks meet, each pair of blocks once, however many tables they share; only then vectors are joined to it, those of the entries that share
a bucket, and compared as a whole. So vectors travel in proportion to pairs of blocks, and no pair is counted twice.
Each pair of blocks returns a count and one link per entry instead of pairs. Bucket numbers have 32 bits; where two tuples fall on one number, the bucket only gets longer. Nothing is capped.

Rows link only if labels are equal and not null and dimensions agree. Vectors that are null, empty, zero or hold
null or non-finite components link with nothing; the largest and smallest finite ones are like others. Repeated rows are vectors like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import labels_of, list_starts, whole_lists
from .common import materialise
from .components import connected_components, joined_by_parts
from .mixing import numbered

THRESHOLD = 0.93
TABLES, PROJECTIONS, WIDTH, SEED = 40, 12, 1.5, 5
BLOCK = 256


def bucket_numbers(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table, as 32-bit numbers."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions = rng.standard_normal((dim, tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    mixing = rng.integers(1, 1 << 63, projections, dtype=np.uint64) | np.uint64(1)
    steps = np.floor((unit @ directions + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    mixed = (steps * mixing).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _buckets(vectors: pa.ListArray, **how) -> pa.Array:
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
    out: list = [None] * len(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        block = flat[(starts[rows][:, None] + np.arange(dim))]
        for row, numbers in zip(rows.tolist(), bucket_numbers(unit_vectors(block), **how)):
            out[row] = numbers
    return pa.array(out, pa.list_(pa.int32()))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept."""
    v, lab = F.col("__vector"), F.col("__label")
    rows = vectors.select(F.col(vec_id).alias("__id"), F.col(vector).alias("__vector"), F.col(label).alias("__label"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = lab.isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    number = F.arrow_udf(lambda x: _buckets(x, tables=tables, projections=projections, width=width), T.ArrayType(T.IntegerType()))
    classes = rows.filter(valid).groupBy("__label", "__vector").agg(F.min("__id").alias("least"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("buckets", number(v)))
    # classes in the order of their buckets stand in blocks: what is alike is mostly in few blocks, whatever the number of tables
    classes = materialise(numbered(classes, F.col("__label"), F.size("__vector"), F.col("buckets"), F.col("cls")).withColumn("block", F.floor(F.col("number") / BLOCK)).drop("number"))
    keys = ["__label", "dim", "table", "bucket"]
    posts = classes.select("cls", "block", "__label", F.size("__vector").alias("dim"), F.posexplode("buckets").alias("table", "bucket"))
    lists = posts.groupBy(*keys).agg(F.collect_set("block").alias("blocks"), F.count("*").alias("members")).filter("members > 1").drop("members")
    met = joined_by_parts(posts, lists, keys, F.col("cls")).withColumn("other", F.explode("blocks"))
    order = ["__label", "dim", "low", "high"]
    # who takes part in a pair of blocks: once, though they may meet in many tables; vectors come to it only here
    parts = met.select("__label", "dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls").distinct()
    dealt = parts.join(classes.select("cls", "n", "__vector"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches, order):
            cls, n, low, high, block = (table.column(c).to_numpy() for c in ("cls", "n", "low", "high", "block"))
            lists = table.column("__vector").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            starts = np.r_[list_starts(table, order), len(cls)]
            counts, label_of = np.zeros(len(cls), np.int64), np.arange(len(cls))
            for lo, hi in zip(starts[:-1], starts[1:]):
                alone = low[lo] == high[lo]
                left = np.flatnonzero(block[lo:hi] == low[lo])
                right = left if alone else np.flatnonzero(block[lo:hi] == high[lo])
                if not len(left) or not len(right):
                    continue
                unit = unit_vectors(flat[ends[lo] : ends[hi]].reshape(hi - lo, -1))
                near = unit[left] @ unit[right].T >= threshold
                if alone:
                    near &= ~np.eye(len(left), dtype=bool)
                if not near.any():
                    continue
                counts[lo + left] += near @ n[lo + right]
                if not alone:
                    counts[lo + right] += n[lo + left] @ near
                i, j = np.nonzero(near)
                label_of[lo:hi] = lo + labels_of(hi - lo, [(left[i], right[j])])
            some = (counts > 0) | (label_of != np.arange(len(cls)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[label_of[some]]), pa.array(counts[some])], names=["a", "b", "n"])

    found = dealt.select(*order, "block", "cls", "n", "__vector").repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long, n long")
    found = materialise(found)
    direct = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("direct"))
    parts = connected_components(found.filter("a != b").select("a", "b")).withColumnRenamed("node", "cls")
    linked = classes.select("cls", "__label", "__vector", "least", "n").join(parts, "cls", "left").join(direct, "cls", "left").withColumn("part", F.coalesce("component", "cls"))
    leasts = linked.groupBy("part").agg(F.min("least").alias("component_id"))
    of = materialise(joined_by_parts(linked, leasts, "part", F.col("cls")).select("__label", "__vector", (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), "component_id"))
    # rows that cannot link keep their null or odd vectors out of the join; the many rows of one vector are dealt into parts
    keyed = rows.select("__id", F.when(valid, F.struct("__label", "__vector")).alias("key"))
    of = of.select(F.struct("__label", "__vector").alias("key"), "n_links", "component_id")
    return (
        joined_by_parts(keyed, of, "key", F.coalesce("__id", F.monotonically_increasing_id()), "left")
        .select(F.col("__id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "__id").alias("component_id"))
        .withColumn("kept", F.col(vec_id) == F.col("component_id"))
    )


def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
