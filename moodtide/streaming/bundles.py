"""Decision bundles: one decision a day for all markets of a panel, made once all of them have that day.

A panel's state holds the sessions that wait, the last bundle's date, digest and positions. A day's bundle is made when every market has a session of that day: positions are carried on from the last bundle and
change by each market's score; sessions that other markets had before that day without a bundle are missed. A bundle's digest covers its content and the digest of the bundle before. Of
repeated sessions the first counts; sessions at or before the last bundle change nothing.

As long as each market's sessions arrive in order of date, a stream gives the bundles of the batch, whatever the micro-batches: a day that a late market still
may have holds the bundle back, and a later day of that market shows that it won't. Sessions later than the watermark's delay are lost. Panels without sessions for `ended_days` end: their state is cleared and a row says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import displayed

BUNDLE = T.StructType([
    T.StructField("panel", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("date", T.StringType()), T.StructField("positions", T.StringType()),
    T.StructField("missed", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("digest", T.StringType()),
])
_DAY_MS = 86_400_000


def content(date: str, positions: str, missed: int, previous: str) -> str:
    return f"{date}|{positions}|{missed}|{previous}"


class Bundles(StatefulProcessor):
    """Rows: panel, market, date (text), shown (the displayed score, null if there is none), at (the date as event time)."""

    def __init__(self, markets: list[str], fear: int, greed: int, ended_days: int):
        self.markets, self.fear, self.greed, self.ended_days = sorted(markets), fear, greed, ended_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "date string, market string", "shown int")
        self.last = handle.getValueState("last", "date string, digest string, positions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, digest, now = self.last.get() if self.last.exists() else ("", hashlib.sha256(key[0].encode()).hexdigest(), ",".join(f"{m}:1" for m in self.markets))
        newest = 0
        for pdf in rows:
            for date, market, shown, at in zip(pdf["date"], pdf["market"], pdf["shown"], pdf["at"]):
                newest = max(newest, int(at.timestamp() * 1000))
                if date > done and market in self.markets and not self.waiting.containsKey((date, market)):
                    self.waiting.updateValue((date, market), (None if pd.isna(shown) else int(shown),))
        held: dict[str, dict[str, int | None]] = {}
        for (date, market), (shown,) in self.waiting.iterator():
            held.setdefault(date, {})[market] = shown
        out, missed, gone = [], 0, []
        positions = dict(x.rsplit(":", 1) for x in now.split(","))
        for date in sorted(held):
            gone.append(date)
            if len(held[date]) < len(self.markets):
                missed += len(held[date])
                continue
            for m, shown in held[date].items():
                if shown is not None:
                    positions[m] = "0" if shown >= self.greed else "1" if shown <= self.fear else positions[m]
            now = ",".join(f"{m}:{positions[m]}" for m in self.markets)
            previous, digest = digest, hashlib.sha256(content(date, now, missed, digest).encode()).hexdigest()
            out.append((key[0], "BUNDLE", date, now, missed, previous, digest))
            done, missed = date, 0
            for d in gone:
                for m in held[d]:
                    self.waiting.removeKey((d, m))
            gone = []
        self.last.update((done, digest, now))
        for t in list(self.handle.listTimers()):
            if t < newest + self.ended_days * _DAY_MS:
                self.handle.deleteTimer(t)
            else:
                newest = t - self.ended_days * _DAY_MS
        self.handle.registerTimer(newest + self.ended_days * _DAY_MS)
        yield pd.DataFrame(out, columns=BUNDLE.names).astype({"missed": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, digest, now = self.last.get() if self.last.exists() else ("", "", "")
        self.last.clear()
        self.waiting.clear()
        yield pd.DataFrame([(key[0], "ENDED", done, now, 0, digest, digest)], columns=BUNDLE.names)

    def close(self) -> None:
        pass


def bundle_stream(sessions: DataFrame, markets: list[str], fear: int = 25, greed: int = 75, delay: str = "60 days", ended_days: int = 400) -> DataFrame:
    """Bundles of a stream of sessions (panel, market, date, score). The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = sessions.select("panel", "market", F.col("date").cast("string").alias("date"), displayed(F.col("score")).alias("shown"), F.to_timestamp("date").alias("at")).withWatermark("at", delay)
    return rows.groupBy("panel").transformWithStateInPandas(Bundles(markets, fear, greed, ended_days), BUNDLE, "Append", "EventTime")


def bundles(sessions: DataFrame, markets: list[str], fear: int = 25, greed: int = 75) -> DataFrame:
    """The same for a table: panel, date, positions, missed, previous, digest. A panel's bundles, one a day, are chained in one row."""
    w = Window.partitionBy("panel", "market", "date").orderBy(F.monotonically_increasing_id())
    rows = sessions.filter(F.col("market").isin(*markets)).withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    days = rows.groupBy("panel", "date").agg(F.count("*").alias("n"))
    whole = days.filter(F.col("n") == len(markets)).select("panel", "date")
    shown = displayed(F.col("score"))
    # the decision of a day is in force from that day's bundle on, so each row's own event counts
    events = rows.join(whole, ["panel", "date"]).withColumn("position", F.coalesce(F.last(F.when(shown >= greed, 0).when(shown <= fear, 1), ignorenulls=True).over(Window.partitionBy("panel", "market").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))
    held = events.groupBy("panel", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("market", "position"))), lambda x: F.concat(x["market"], F.lit(":"), x["position"].cast("string"))), ",").alias("positions"))
    by_day = Window.partitionBy("panel").orderBy("date")
    counted = days.withColumn("_missed", F.when(F.col("n") < len(markets), F.col("n")).otherwise(0)).withColumn("_sum", F.sum("_missed").over(by_day)).filter(F.col("n") == len(markets))
    counted = counted.withColumn("missed", F.col("_sum") - F.coalesce(F.lag("_sum").over(by_day), F.lit(0))).select("panel", "date", "missed")
    listed = held.join(counted, ["panel", "date"]).groupBy("panel").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "positions", "missed"))).alias("b"))
    kind = "array<struct<date: string, positions: string, missed: bigint, previous: string, digest: string>>"
    start = F.struct(F.sha2("panel", 256).alias("last"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        digest = F.sha2(F.concat_ws("|", x["date"], x["positions"], x["missed"].cast("string"), acc["last"]), 256)
        return F.struct(digest.alias("last"), F.concat(acc["out"], F.array(F.struct(x["date"].alias("date"), x["positions"].alias("positions"), x["missed"].cast("bigint").alias("missed"), acc["last"].alias("previous"), digest.alias("digest")))).alias("out"))

    return listed.select("panel", F.explode(F.aggregate("b", start, add)["out"]).alias("e")).select("panel", "e.*")
