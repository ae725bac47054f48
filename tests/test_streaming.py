"""Streams give what batches give."""

import datetime as dt

from pyspark.sql import functions as F

from moodtide.streaming import ledger as L


def sessions(spark, n=12):
    return spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i * (1 + k)) for k, s in enumerate("ab") for i in range(n)], "symbol string, date date, close double")


def test_matured_events_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = sessions(spark)
    for part in range(3):  # three files, in order of date, the last with a repeated session
        lo, hi = dt.date(2020, 1, 1 + 4 * part), dt.date(2020, 1, 4 + 4 * part)
        chosen = rows.filter((F.col("date") >= lo) & (F.col("date") <= hi))
        chosen = chosen.union(rows.filter(F.col("date") == dt.date(2020, 1, 4))) if part == 2 else chosen
        chosen.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{part}"))
    target = tmp_path / "in"
    target.mkdir()
    for part in range(3):
        for f in (tmp_path / f"in{part}").glob("part-*"):
            f.rename(target / f"{part}-{f.name}")
        stream = spark.readStream.schema(rows.schema).parquet(str(target))
        q = L.matured_stream(stream, "symbol").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r["symbol"], str(r["date"]), r["kind"], str(r["at"]), round(r["value"], 9))
    assert sorted(map(key, events.collect())) == sorted(map(key, L.matured(rows, ["symbol"]).collect()))


def test_first_value_wins_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 1.0), ("b", dt.datetime(2020, 1, 1), 2.0)], "k string, at timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.withColumn("v", F.col("v") + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.first_wins_stream(stream, ["k"], "at", "7 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_broken_chain_is_found(spark):
    chain = L.chained(sessions(spark, 5), ["symbol"], "date", ["date", "close"])
    assert L.broken(chain, ["symbol"], "date", ["date", "close"]).count() == 0
    changed = chain.withColumn("close", F.when((F.col("symbol") == "a") & (F.dayofmonth("date") == 3), 99.0).otherwise(F.col("close")))
    bad = L.broken(changed, ["symbol"], "date", ["date", "close"]).collect()
    assert sorted(str(r.date) for r in bad) == ["2020-01-03", "2020-01-04"]
