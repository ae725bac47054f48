"""Comparing the members of index lists with one another, without a row for each pair.

Rows are sorted by list within each task; one Arrow function walks over them and compares row i with row
i + 1, i + 2, ... of the same list, vectorised over all lists of a batch. Lists over `block` rows are cut into
blocks by a hash, and each pair of blocks is a unit of its own that any task can take, so that neither a task nor
a batch holds a long list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(posts: DataFrame, keys: list[str], spread: Column, block: int) -> DataFrame:
    """posts of lists with two rows or more, with `unit` (an integer for the pair of blocks) and `side`: 0 where a
    block meets itself, else 1 and 2 for the two blocks, one of which may have no rows.

    Lists are counted with partial sums and joined back; only lists over `block` rows are dealt into blocks, each row into as many units as its list has blocks.
    The join is a merge join: posts are mostly exploded from a small table, whose size Spark takes for theirs, and would be broadcast through the driver.
    """
    sizes = posts.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(spread, F.col("blocks")).cast("int")
    dealt = posts.join(sizes.hint("merge"), keys).withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other)
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("unit", lo * F.col("blocks") + hi).withColumn("side", side).drop("n", "blocks", "mine", "other")


def whole_lists(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a list ends; input is sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = list_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def list_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def near_pairs(starts: np.ndarray, n: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray], at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the same list for which close(i, j) holds, some at a time."""
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    alive, step = np.arange(n), 1
    while True:
        alive = alive[alive + step < ends[alive]]
        if not len(alive):
            return
        for k in range(0, len(alive), at_once):
            i = alive[k : k + at_once]
            ok = close(i, i + step)
            if ok.any():
                yield i[ok], i[ok] + step
        step += 1


def labels_of(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each index the smallest index that the pairs lead to."""
    label = np.arange(n)
    if not pairs:
        return label
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label
