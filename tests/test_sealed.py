"""A sealed selection: development never sees the holdout, and a changed ledger keeps it closed."""

import pytest
from pyspark.sql import functions as F

from moodtide.operators import sealed as Z


def test_selection_is_sealed_before_the_holdout_is_read(spark, tmp_path):
    rows = spark.range(60).select(F.when(F.col("id") < 40, "development").otherwise("holdout").alias("stage"), (F.col("id") % 3).alias("rule"), (F.col("id") * F.col("id") % 17).cast("double").alias("gain"))
    place = str(tmp_path / "a")
    Z.deal(rows, place)
    select = lambda df: df.groupBy("rule").agg(F.avg("gain").alias("gain")).orderBy(F.desc("gain"), "rule").limit(1)
    (tmp_path / "a" / "rows" / "stage=holdout").rename(tmp_path / "away")  # not there while the first phase runs
    ledger = Z.seal(spark, place, select)
    assert all("stage=holdout" not in f for f in Z.part(spark, place, "development").inputFiles()) and ledger.count() == 1
    (tmp_path / "away").rename(tmp_path / "a" / "rows" / "stage=holdout")
    found, holdout = Z.opened(spark, place, select)
    assert found.first() == select(rows.filter("stage = 'development'")).first() and holdout.count() == 20

    spark.createDataFrame([(0, 99.0)], "rule long, gain double").write.mode("overwrite").parquet(f"{place}/ledger")
    assert Z.problems(spark, place, select) == ["ledger", "replay"]
    with pytest.raises(Z.SealBroken):
        Z.opened(spark, place, select)


def test_changed_development_rows_and_another_rule_break_the_seal(spark, tmp_path):
    rows = spark.range(20).select(F.lit("development").alias("stage"), (F.col("id") % 2).alias("rule"), F.col("id").cast("double").alias("gain"))
    place = str(tmp_path / "b")
    Z.deal(rows, place)
    best = lambda df: df.groupBy("rule").agg(F.max("gain").alias("gain")).filter("gain > 18")
    Z.seal(spark, place, best)
    assert Z.problems(spark, place, best) == []
    assert Z.problems(spark, place, lambda df: df.groupBy("rule").agg(F.max("gain").alias("gain"))) == ["replay"]
    rows.limit(1).drop("stage").write.mode("append").parquet(f"{place}/rows/stage=development")
    assert Z.problems(spark, place, best) == ["development"]
