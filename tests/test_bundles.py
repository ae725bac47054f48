"""Bundles of a stream equal those of the batch, whatever the micro-batches; late markets hold them back; ended panels are forgotten."""

import datetime as dt
import random

import pytest

from moodtide.streaming import bundles as B

MARKETS = ["a", "b", "c"]
DAY = dt.date(2020, 1, 1)


def sessions(draw, n=25):
    rows = []
    for m in MARKETS:
        for i in range(n):
            if draw.random() < 0.85:
                rows.append(("p", m, DAY + dt.timedelta(days=i), draw.choice([None, 10.0, 50.0, 90.0, 24.96])))
    return rows


def run(spark, tmp_path, parts, **how):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, seen = [], []
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, "panel string, market string, date date, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("panel string, market string, date date, score double").parquet(str(tmp_path / "in"))

            def keep(batch, _):
                out.extend(batch.collect())

            q = B.bundle_stream(stream, MARKETS, **how).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
            q.awaitTermination()
            seen.append(len(out))
    finally:
        spark.conf.unset(key)
    return out, seen


def cut_up(draw, rows, n):
    """Any split into n parts that keeps each market's order."""
    parts = [[] for _ in range(n)]
    for m in MARKETS:
        mine = [r for r in rows if r[1] == m]
        edges = sorted(draw.choices(range(len(mine) + 1), k=n - 1))
        for k, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(mine)])):
            parts[k] += mine[lo:hi]
    return [p for p in parts if p]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = sessions(draw)
    rows = rows + [(*r[:3], 1.0) for r in rows[:4]]  # repeated sessions: the first counts
    batch = B.bundles(spark.createDataFrame(rows, "panel string, market string, date date, score double").coalesce(1), MARKETS)
    expected = sorted((r.date, r.positions, r.missed, r.previous, r.digest) for r in batch.collect())
    got, _ = run(spark, tmp_path, cut_up(draw, rows, 4))
    assert {r.kind for r in got} == {"BUNDLE"} and len(expected) > 5
    assert sorted((r.date, r.positions, r.missed, r.previous, r.digest) for r in got) == expected


def test_a_late_market_holds_the_bundle_back(spark, tmp_path):
    day = lambda i: DAY + dt.timedelta(days=i)
    parts = [
        [("p", "a", day(0), 90.0), ("p", "b", day(0), 50.0)],
        [("p", "a", day(1), 50.0), ("p", "b", day(1), 50.0), ("p", "x", day(1), 1.0)],
        [("p", "c", day(0), 50.0)],
        [("p", "c", day(1), 10.0), ("p", "c", day(2), 10.0), ("q", "a", day(900), 5.0)],
        [("q", "b", day(901), 5.0)],
    ]
    got, seen = run(spark, tmp_path, parts)
    assert seen[:3] == [0, 0, 1] and [(r.kind, r.date, r.positions) for r in got if r.panel == "p"] == [
        ("BUNDLE", "2020-01-01", "a:0,b:1,c:1"), ("BUNDLE", "2020-01-02", "a:0,b:1,c:1"), ("ENDED", "2020-01-02", "a:0,b:1,c:1"),
    ]
    assert got[1].previous == got[0].digest
