"""Cutting the lineage of plans by checkpoints or tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as cut() uses it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        alone = sc.master.split("[")[0] == "local"
        named = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="moodtide-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir; where that is unset, in the warehouse, or, where all run on one machine, in a temporary folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the same folder: for what is read more than once, since each reader takes its columns and rows only. It is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/moodtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
