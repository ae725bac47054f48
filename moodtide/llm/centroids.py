"""Clustering integer vectors around centroids, with Hamerly's bounds.

Vectors become integers, floor(SCALE * x), so that sums, centroids and distances are exact and any order of adding gives the same
result. Each vector carries its cluster and two bounds: an upper one on the distance to its centroid and a lower one on the distance
to the second nearest. When centroids move, the upper bound grows by the drift of its centroid and the lower one shrinks by the largest drift of the others. A
vector whose upper bound stays below the lower one, or below half the way from its centroid to the nearest other, keeps its
cluster unseen. Else its own distance is computed anew; if that doesn't settle it either, all its distances are, in exact integers, ties going to
the smaller number. Bounds are rounded outwards, and only a strict inequality skips, so the clusters are those of a full scan.

Each round writes vectors with their bounds to the shared folder and deletes the round before. Sums by cluster are partial sums of Spark's; the driver gets one row per
cluster and sends the centroids back with the tasks. Rounds end early when no centroid moves, since nothing changes after that.

Vectors that are null, of another length, or hold null or non-finite components are left out. Components beyond +-BOUND / SCALE count as that bound, so that
squared distances fit a long. Repeated rows are vectors like others; among equal ids the smaller vector is the earlier seed. Null ids come last as seeds. With fewer vectors than
clusters there are as many clusters as vectors; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, materialise

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BOUND = 1 << 27
#: Up to this size of components, sums of 64 squares and products are exact in double precision.
EXACT = 1 << 22
#: Share by which bounds are rounded outwards; rounding errors of a few sums are ten thousand times smaller.
SLACK = 1e-12
_LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and q (integers) of the vectors that can be clustered."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    return vectors.filter(x.isNotNull() & (F.size(x) == dimensions) & ~odd).select(F.col(vec_id).alias("vec_id"), q.alias("q"))


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of q to each centroid."""
    largest = max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest <= EXACT and q.shape[1] <= DIMENSIONS else np.int64
    a, b = q.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def assigned(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after the centroids moved by drift, and which vectors were scanned in full."""
    k = len(centroids)
    cluster, upper, lower = cluster.copy(), upper + drift[cluster], lower.copy()
    apart = np.sqrt(squared(centroids, centroids).astype(float))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(axis=1) / 2 * (1 - SLACK)
    others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(k)])
    lower -= others[cluster]
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    if len(open_):
        own = ((q[open_].astype(np.int64) - centroids[cluster[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(own.astype(float)) * (1 + SLACK)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
    scanned = np.zeros(len(q), bool)
    scanned[open_] = True
    if len(open_):
        d = squared(q[open_], centroids)
        cluster[open_] = best = d.argmin(axis=1)  # the first of equal ones
        upper[open_] = np.sqrt(d[np.arange(len(d)), best].astype(float)) * (1 + SLACK)
        d[np.arange(len(d)), best] = _LONGEST
        lower[open_] = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK) if k > 1 else np.inf
    return cluster, upper, lower, scanned


def _assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").flatten().to_numpy().reshape(b.num_rows, -1)
            c, u, lo, scanned = assigned(q, *(b.column(x).to_numpy() for x in ("cluster", "upper", "lower")), centroids, drift)
            scans = b.column("scans").to_numpy() + scanned
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(c, pa.int32()), pa.array(u), pa.array(lo), pa.array(scans, pa.int32())], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, q, cluster, upper, lower and scans (full scans so far) after `rounds` rounds and a last assignment; and the centroids."""
    start = F.lit(0).cast("int")
    fresh = quantised(vectors, vec_id, vector, dimensions, scale).select("vec_id", "q", start.alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), start.alias("scans"))
    state = materialise(fresh)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.orderBy(digest.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    centroids = np.array([r.q for r in seeds], np.int64).reshape(len(seeds), dimensions)
    drift = np.zeros(len(seeds))
    if not len(seeds):
        return state, centroids
    for left in range(rounds, -1, -1):
        after = materialise(_assign(state, centroids, drift))
        drop_materialised(state)
        state = after
        if not left:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("q")[i].cast("long")) for i in range(dimensions))).alias("sums")).collect()
        moved = centroids.copy()
        for r in sums:
            moved[r.cluster] = [s // r.n for s in r.sums]
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        centroids = moved
        if not drift.any():
            break
    return state, centroids


def _by_cluster(values: dict[int, object], kind: str) -> Column:
    """The value of each cluster, of which there are as many as the parameter says."""
    pairs = [F.lit(x) for c in sorted(values) for x in (c, values[c])]
    return F.element_at(F.create_map(*pairs), F.col("cluster")).cast(kind) if pairs else F.lit(None).cast(kind)


def report(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia and inertia (its sums; none above the largest long), centroid_sha256, scans."""
    fixed = [[int(x) for x in c] for c in centroids]

    def own(q: pa.Array, cluster: pa.Array) -> pa.Array:
        c = cluster.to_numpy()
        v = q.flatten().to_numpy().reshape(len(c), -1).astype(np.int64)
        return pa.array(((v - np.array(fixed, np.int64)[c]) ** 2).sum(axis=1) if len(c) else [], pa.int64())

    measured = materialise(state.select("vec_id", "cluster", F.arrow_udf(own, "long")("q", "cluster").alias("distance"), "scans"))
    sums = {r.cluster: int(r.s) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(fixed)}
    inertia = F.lit(min(sum(sums.values()), _LONGEST)).cast("long")
    return measured.select("vec_id", "cluster", "distance", _by_cluster({c: min(s, _LONGEST) for c, s in sums.items()}, "long").alias("cluster_inertia"), inertia.alias("inertia"), _by_cluster(digests, "string").alias("centroid_sha256"), "scans")


def op11_centroid_clustering(spark, sf_dir):
    return report(*cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).drop("scans")


def _oracle() -> str:
    """The rounds written out one after the other, each with a full scan."""
    parts = [
        f"""v0 as materialized (select row_number() over () as rid, vec_id, embedding as e from embeddings where len(embedding) = {DIMENSIONS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
        f"""v as materialized (select rid, vec_id, p.i as i, floor({SCALE} * e[p.i]::double)::bigint as q from v0, range(1, {DIMENSIONS + 1}) as p(i))""",
        f"""s as materialized (select rid, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from v0 qualify c < {CLUSTERS})""",
        """c0 as materialized (select s.c, v.i, v.q from s join v on s.rid = v.rid)""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} as materialized (select rid, c, sum((v.q - c{r}.q) * (v.q - c{r}.q))::bigint as d from v join c{r} on v.i = c{r}.i group by rid, c)")
        parts.append(f"a{r} as materialized (select rid, c, d from d{r} qualify row_number() over (partition by rid order by d, c) = 1)")
        if r < ROUNDS:
            parts.append(f"m{r} as (select a.c, v.i, sum(v.q) as s, count(*) as n from a{r} a join v on a.rid = v.rid group by a.c, v.i)")
            whole = "(case when m.s >= 0 then m.s // m.n else -((-m.s + m.n - 1) // m.n) end)::bigint"
            parts.append(f"c{r + 1} as materialized (select c{r}.c, c{r}.i, coalesce({whole}, c{r}.q) as q from c{r} left join m{r} m on m.c = c{r}.c and m.i = c{r}.i)")
    last = ROUNDS
    return (
        "with " + ",\n".join(parts) + f""",
digests as (select c, sha256(string_agg(q::varchar, ',' order by i)) as centroid_sha256 from c{last} group by c)
select v0.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, centroid_sha256
from a{last} a join v0 on a.rid = v0.rid join digests on digests.c = a.c"""
    )


ORACLE = _oracle()
