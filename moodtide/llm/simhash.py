"""Near-duplicate documents by SimHash fingerprints.

Fingerprints have 64 bits over the XXH64 of word shingles, repeats included. Two fingerprints that differ in at most d bits
differ in at most d of their eight bytes, hence share at least 8 - d bytes at the same positions. An inverted
index over byte positions finds such pairs. One byte has 256 values, so that its lists would hold a fixed
share of all fingerprints; therefore a list belongs to a group of `group` positions with their bytes, and
of the positions only the first group + d are indexed: of those, any linked pair shares at least `group`
(prefix filtering for overlap counts). Where two fingerprints meet, the tally of shared positional bytes
over all eight positions must reach 8 - d, and what is left is verified by the differing bits.

Equal fingerprints are one entry of the index, so that copies, however many, cost one entry. Lists are compared
in blocks inside tasks, and each unit returns at most one link per entry, to the smallest entry that its
links lead to: fewer rows than pairs, and the same components. Nothing is capped.

Null and empty texts and those of white space have the fingerprint zero and are linked like any other. Texts with fewer words than a
shingle have one shingle of all their words. Repeated rows and ids get equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import labels_of, list_starts, near_pairs, units, whole_lists
from .common import materialise
from .components import connected_components

SHINGLE, DISTANCE, GROUP, SEED = 3, 3, 4, 42
BLOCK = 4096
#: Shingles hashed at once; bounds what a long text takes.
CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = max(len(words) - shingle + 1, 1) if words else 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(k, min(n, k + CHUNK))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each whole text, as a signed long."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(of, T.LongType()).asNondeterministic()(text)


def index_keys(distance: int, group: int) -> list[tuple[int, ...]]:
    return list(combinations(range(min(8, group + distance)), group))


def postings(prints: DataFrame, distance: int, group: int) -> DataFrame:
    """One row per fingerprint `fp` and indexed group of positions: `list` names the group and its bytes."""
    rows = []
    for k, positions in enumerate(index_keys(distance, group)):
        mask = sum(0xFF << 8 * p for p in positions)
        mask -= (mask >> 63) << 64
        rows.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    return prints.select("fp", F.posexplode(F.array(*rows)).alias("key", "list"))


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """a, b: links among distinct fingerprints `fp` whose components are those of all pairs within the distance."""
    dealt = units(postings(prints, distance, group), ["key", "list"], F.xxhash64("fp"), BLOCK)
    order = ["key", "list", "unit"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches, order):
            fp = table.column("fp").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            starts = list_starts(table, order)

            def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                differ = fp[i] ^ fp[j]
                tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                ok = (tally >= 8 - distance) & ((side[i] == 0) | (side[i] != side[j]))
                ok[ok] = np.bitwise_count(differ[ok]) <= distance
                return ok

            label = labels_of(len(fp), list(near_pairs(starts, len(fp), close)))
            moved = label != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])

    found = dealt.select(*order, "side", "fp").repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")
    return found.distinct()


def grouped(printed: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """printed with __component and __first. Rows of equal __fp are one class; links_of takes the classes `fp` and returns links among them."""
    classes = materialise(printed.groupBy(F.col("__fp").alias("fp")).agg(F.min("__doc").alias("least")))
    parts = connected_components(links_of(classes.select("fp")))
    linked = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = linked.groupBy("part").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("x"))
    of = materialise(linked.join(least, "part").select(F.col("fp").alias("__fp"), F.col("x.least").alias("__component"), F.col("x.fp").alias("__first")))
    return printed.join(of, "__fp")


def first_of_each(found: DataFrame, columns: list[str]) -> DataFrame:
    """Of each component the row with the smallest __doc, one of those that also share __fp with it, with its kept columns."""
    first = found.filter((F.col("__fp") == F.col("__first")) & F.col("__doc").eqNullSafe(F.col("__component")))
    return first.dropDuplicates(["__doc", "__fp"]).select(*(F.col(f"`__keep_{c}`").alias(c) for c in columns))


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int, group: int, keep: list[str]) -> DataFrame:
    """__doc, __fp, __component, __first and __keep_<c> for each kept column: names that columns of docs can't clash with."""
    kept = [F.col(f"`{c}`").alias(f"__keep_{c}") for c in keep]
    printed = materialise(docs.select(F.col(doc_id).alias("__doc"), *kept, fingerprint(F.col(text), shingle).alias("__fp")))
    return grouped(printed, lambda classes: links(classes, distance, group))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long), component_id (the smallest doc_id that links lead to; null only if all are) and
    first_fp (the fingerprint of the row that has it), and the columns named by keep but those with one of these names."""
    own = (doc_id, "fp", "component_id", "first_fp")
    found = _grouped(docs, doc_id, text, shingle, distance, group, [c for c in keep if c not in own])
    return found.select(*(F.col(c).alias(n) for c, n in zip(("__doc", "__fp", "__component", "__first"), own)), *(F.col(f"`__keep_{c}`").alias(c) for c in keep if c not in own))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns. Of rows that also
    share id and fingerprint with it one stays."""
    return first_of_each(_grouped(docs, doc_id, text, shingle, distance, group, docs.columns), docs.columns)


def op3_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
