"""Best-fit packing of token sequences, improved by a local search.

Each document is its ids and one separator id. Only documents longer than a sequence are cut, from their
end, so that all pieces but the first are full. Pieces are dealt evenly over tasks of a bounded number of rows;
each task packs its pieces by best fit in order of size, then exchanges documents between underfull bins.
An exchange moves one document, swaps one for a smaller one, or one for two smaller ones, always so that
the sum of squared fills grows; bins that become empty are saved sequences. Since it grows, the search ends: when a sweep over
all underfull bins finds no exchange, or once no packing of these pieces could take fewer sequences. A task loses less than about one
sequence against packing all at once, which is little against the thousands that it fills.

A null text is an empty one: a document of the separator only. Repeated rows are packed as often as they come.
Sequence ids are the task's number and the sequence's number in it. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .tokens import encoder

CAPACITY = 2048
#: Pieces that one task packs; bounds its memory and time.
TASK_PIECES = 40_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: pieces by falling size, each to the fullest bin that holds it."""
    where = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if fits := rooms >> n << n:
            room = (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i] = b
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return where


def pairs_in_bins(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of documents that share a bin, one for each pair of sizes in it. A bin holds few different
    sizes, as their sum is at most its capacity (63 for 2048), so however many documents it holds its pairs are bounded."""
    order = np.lexsort((sizes, bins))
    b, n = bins[order], sizes[order]
    # a third document of the same size makes no new pair of sizes
    third = np.r_[np.zeros(min(2, len(b)), bool), (b[2:] == b[:-2]) & (n[2:] == n[:-2])]
    order, b, n = order[~third], b[~third], n[~third]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    d = 1
    while (b[d:] == b[:-d]).any():
        i = np.flatnonzero(b[d:] == b[:-d])
        # of two equal sizes only the second is paired with what follows
        i = i[(n[i] != n[i + 1]) | (b[i] != b[i + 1]) | (d == 1)]
        left.append(order[i])
        right.append(order[i + d])
        d += 1
    return np.concatenate(left), np.concatenate(right)


def improve(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """The bins after the local search."""
    where = where.copy()
    least = -(-int(sizes.sum()) // capacity)
    while len(sizes):
        fill = np.bincount(where, sizes).astype(np.int64)
        if np.count_nonzero(fill) <= least:
            break
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        docs = np.flatnonzero((fill < capacity)[where])
        size, own = sizes[docs], where[docs]
        first, second = pairs_in_bins(own, size)
        both = size[first] + size[second]
        exchanges = 0
        for s in under[np.argsort(fill[under], kind="stable")].tolist():
            for a in sorted(np.flatnonzero(own == s).tolist(), key=lambda i: -size[i]):
                n = size[a]
                room = np.where(fill[under] > 0, capacity - fill[under], -1)
                gain = fill[under] - fill[s] + n > 0
                ok = np.flatnonzero((room >= n) & gain & (under != s))
                if len(ok):
                    t = under[ok[np.argmin(room[ok])]]
                    own[a] = t
                    fill[t] += n
                    fill[s] -= n
                    exchanges += 1
                    continue
                grown = n - size
                ok = np.flatnonzero((own != s) & (grown > 0) & (fill[own] + grown <= capacity) & (fill[own] - fill[s] + grown > 0))
                if len(ok):
                    b = ok[np.argmax(grown[ok])]
                    t, g = own[b], grown[b]
                    own[a], own[b] = t, s
                    fill[t] += g
                    fill[s] -= g
                    exchanges += 1
                    continue
                bins, grown = own[first], n - both
                ok = np.flatnonzero((bins == own[second]) & (bins != s) & (grown > 0) & (fill[bins] + grown <= capacity) & (fill[bins] - fill[s] + grown > 0))
                if len(ok):
                    k = ok[np.argmax(grown[ok])]
                    t, g = bins[k], grown[k]
                    own[a], own[first[k]], own[second[k]] = t, s, s
                    fill[t] += g
                    fill[s] -= g
                    exchanges += 1
            if np.count_nonzero(fill) <= least:
                break
        where[docs] = own
        if not exchanges:
            break
    return where


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (numbered from 0) and the offset in it of each piece."""
    where = improve(sizes, best_fit(sizes, capacity), capacity)
    _, where = np.unique(where, return_inverse=True)
    order = np.lexsort((-sizes, where))
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    w = where[order]
    new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
    base = np.repeat(starts[new], np.diff(np.r_[new, len(w)]))
    offset = np.empty(len(sizes), np.int64)
    offset[order] = starts - base
    return where, offset


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).many, int(separator).to_bytes(4, "little")
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("doc", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
            for row, ids in enumerate(encode(t.as_py() for t in batch.column(1))):
                ids += end
                n = len(ids) // 4
                head = (n - 1) % capacity + 1
                for p, (lo, hi) in enumerate(zip([0, *range(head, n, capacity)], range(head, n + 1, capacity))):
                    part = ids[4 * lo : 4 * hi]
                    for k, v in zip(rows, (row, p, lo, hi - lo, zlib.crc32(part), list(memoryview(part).cast("I")) if with_ids else None)):
                        rows[k].append(v)
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
            columns = [batch.column(0).take(pa.array(rows.pop("doc"), pa.int64()))] + [pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, *rows])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(doc_id, text).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset added; columns of pieces with these names go, the others stay. pieces are written out once, since
    their number sets the number of tasks."""
    pieces = materialise(pieces.drop("sequence_id", "offset"))
    tasks = max(1, -(-pieces.count() // TASK_PIECES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        where, offset = pack(table.column(length).to_numpy().astype(np.int64), capacity)
        task = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(where + task, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches(10_000)

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.repartition(tasks).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    return pack_pieces(token_pieces(docs, path, doc_id, text, capacity, separator, with_ids), capacity)


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
