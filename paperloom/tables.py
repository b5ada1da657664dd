"""Working tables in the folder that driver and executors share, and joins by checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run on one machine,
    as in tests, a new one; on a cluster that is an error, since no local folder would be shared."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        pass


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/paperloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the written table: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove tables that keep() wrote, once all that is made of them has been kept itself."""
    for df in tables:
        _remove(df.sparkSession, df._kept)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, marked to be broadcast in a join if it has no more rows than that; else Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
