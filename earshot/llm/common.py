"""What several operators share: shared-folder tables, text clean-up, stable hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The separators of WORD, for bytes.split-like work in Python.
SEPARATORS = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, local mode takes a new local one; a cluster, whose
    executors would each write to their own disk, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-earshot-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: cuts lineage and survives lost executors.

    Once it is written, nothing needs the shuffle files of its steps: Spark is told to delete them.
    """
    path, conf, key = f"{shared_dir(df.sparkSession)}/earshot-{uuid.uuid4().hex}", df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._earshot_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of saved() that nothing reads any more."""
    path = getattr(df, "_earshot_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as texts may be long. Leaves a smaller setting alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(key, "10000")
    if int(now) <= 0 or int(now) > rows:
        spark.conf.set(key, str(rows))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text modulo modulus; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
