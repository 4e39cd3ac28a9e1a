"""Tables in the shared folder: steps that are computed once and read by what follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, an error, but in local mode a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-earshot-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared folder and read again: computed once, whoever reads it, and safe from lost
    executors. It goes when the application ends, or earlier by free()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _place(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._earshot_table = path
    return out


def free(df: DataFrame) -> None:
    """Delete a table of saved() that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_earshot_table", None)
    if path:
        system, at = _place(df.sparkSession, path)
        system.delete(at, True)


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to several tasks a core: a small file is read by one task, however dear what is made of its rows.
    They are shuffled once, so that it pays for narrow rows before they grow."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
