"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse, or, where all run on one machine, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        alone = sc.master.split("[")[0] == "local"
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="moodtide-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and a lost executor
    costs only the tasks that ran on it. The table is compressed and columnar, so it takes less room than
    a checkpoint of rows. It is deleted when the application ends, or by drop_materialised()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moodtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        if "moodtide-" in path.getName():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
