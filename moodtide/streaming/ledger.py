"""An append-only ledger: first value wins, events mature at later sessions, entries are chained by hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_wins(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first entry recorded; later ones with other values are `revisions` of it. Batch form."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return entries.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_wins_stream(entries: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The same for a stream; an entry later than the delay no longer meets what it repeats."""
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def chained(entries: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Each entry's digest and that of the entry before it (of the series' name for the first), and days since it."""
    w = Window.partitionBy(*keys).orderBy(order)
    digest = F.sha2(F.to_json(F.struct(*sorted(payload))), 256)
    return entries.withColumn("digest", digest).withColumn("previous", F.coalesce(F.lag("digest").over(w), F.sha2(F.concat_ws("|", *keys), 256))).withColumn("gap", F.datediff(F.col(order), F.lag(order).over(w)))


def broken(chain: DataFrame, keys: list[str], order: str, payload: list[str], most_days: int = 7) -> DataFrame:
    """Entries whose recorded digests don't follow from the entries themselves, or that come too late after the one before."""
    again = chained(chain.drop("digest", "previous", "gap"), keys, order, payload)
    recorded = chain.select(*keys, order, F.col("digest").alias("_d"), F.col("previous").alias("_p"))
    both = again.join(recorded, [*keys, order])
    return both.withColumn("problem", F.when((F.col("digest") != F.col("_d")) | (F.col("previous") != F.col("_p")), "chain").when(F.col("gap") > most_days, "gap")).filter("problem is not null").drop("_d", "_p")


def matured(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Each decision's fill at the next session and outcome at the one after it. decisions: keys, date, close. Batch form."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = decisions.select(*keys, "date", "close", F.lead("date", 1).over(w).alias("fill_date"), F.lead("close", 1).over(w).alias("fill"), F.lead("date", 2).over(w).alias("outcome_date"), F.lead("close", 2).over(w).alias("_exit"))
    fills = rows.filter("fill_date is not null").select(*keys, "date", F.lit("FILL").alias("kind"), F.col("fill_date").alias("at"), F.col("fill").alias("value"))
    outcomes = rows.filter("outcome_date is not null").select(*keys, "date", F.lit("OUTCOME").alias("kind"), F.col("outcome_date").alias("at"), F.log(F.col("_exit") / F.col("fill")).alias("value"))
    return fills.unionByName(outcomes)


def matured_stream(sessions: DataFrame, key: str) -> DataFrame:
    """The same for a stream of sessions that arrives in order of date: the state of a key is its last two sessions, and each event comes once.
    Sessions at or before the last one seen are not admitted."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        known = [(held[i], held[i + 1]) for i in range(0, len(held), 2)]
        new = pd.concat(list(batches)).sort_values("date")
        out = []
        for date, close in zip(new["date"].astype(str), new["close"]):
            if known and date <= known[-1][0]:
                continue
            if known:
                out.append((k[0], known[-1][0], "FILL", date, close))
            if len(known) > 1:
                out.append((k[0], known[-2][0], "OUTCOME", date, math.log(close / float(known[-1][1]))))
            known = [*known[-1:], (date, str(close))]
        state.update(([x for pair in known for x in pair],))
        yield pd.DataFrame(out, columns=[key, "date", "kind", "at", "value"]).astype({"value": "float64"})

    return sessions.groupBy(key).applyInPandasWithState(step, f"`{key}` string, date string, kind string, at string, value double", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def endpoint(origins: DataFrame, keys: list[str], rows: int = 756, days: int = 1095) -> DataFrame:
    """The first so many origins of each series, if they span enough days since the first; never extended."""
    w = Window.partitionBy(*keys).orderBy("date")
    first = origins.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= rows)
    span = Window.partitionBy(*keys)
    return first.withColumn("complete", (F.count("*").over(span) == rows) & (F.datediff(F.max("date").over(span), F.min("date").over(span)) >= days)).drop("_k")
