"""Selection that is sealed before the holdout is opened.

Rows are dealt into a folder per stage. The first phase reads the development folder only, and writes what it selects with a digest of its rows and of the rows it was selected from. The
second phase goes no further unless the ledger still has that digest and selecting again from the development rows gives the same ledger; only then it reads the holdout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import digests

Select = Callable[[DataFrame], DataFrame]


class SealBroken(ValueError):
    """The ledger isn't the one that was sealed, or doesn't follow from the development rows."""


def deal(rows: DataFrame, folder: str, stage: str = "stage") -> None:
    """Writes rows into folder/rows/stage=..., one folder per stage, also where a stage has no rows."""
    for name in ("development", "holdout"):
        rows.filter(F.col(stage) == name).drop(stage).write.parquet(f"{folder}/rows/stage={name}")


def part(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """The rows of one stage, whose folder alone is listed and read."""
    return spark.read.parquet(f"{folder}/rows/stage={stage}").withColumn("stage", F.lit(stage))


def _digest(rows: DataFrame) -> DataFrame:
    return digests(rows, rows.columns, []).select("n", "a", "b", "x")


def seal(spark: SparkSession, folder: str, select: Select) -> DataFrame:
    """The ledger of what is selected from the development rows, written with its seal."""
    development = part(spark, folder, "development")
    select(development).write.parquet(f"{folder}/ledger")
    ledger = spark.read.parquet(f"{folder}/ledger")
    of = _digest(ledger).select(F.lit("ledger").alias("what"), "*").unionByName(_digest(development).select(F.lit("development").alias("what"), "*"))
    of.write.parquet(f"{folder}/seal")
    return ledger


def problems(spark: SparkSession, folder: str, select: Select) -> list[str]:
    """Why the holdout must stay closed: development rows or ledger changed since the seal, or a ledger that selecting again doesn't give."""
    development, ledger = part(spark, folder, "development"), spark.read.parquet(f"{folder}/ledger")
    sealed = {r.what: tuple(r)[1:] for r in spark.read.parquet(f"{folder}/seal").select("what", "n", "a", "b", "x").collect()}  # two rows
    found = {"ledger": _digest(ledger), "development": _digest(development), "replay": _digest(select(development).select(*ledger.columns))}
    now = {k: tuple(v.first()) for k, v in found.items()}
    return [k for k in ("development", "ledger") if now[k] != sealed.get(k)] + ["replay"] * (now["replay"] != now["ledger"])


def opened(spark: SparkSession, folder: str, select: Select) -> tuple[DataFrame, DataFrame]:
    """The sealed ledger and the holdout rows; SealBroken if anything doesn't hold."""
    if found := problems(spark, folder, select):
        raise SealBroken(", ".join(found))
    return spark.read.parquet(f"{folder}/ledger"), part(spark, folder, "holdout")
