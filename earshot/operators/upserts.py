"""Upserts into a feature table that rewrite what they touch: its folder is laid out by dataset and bucket of clips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.tables import shared_folder

LAYOUT = ["dataset_id", "bucket"]


def laid_out(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(dataset_id, clip_id, ...) with the bucket of their clip, which null and empty ones share; an empty dataset is null,
    as folders cannot tell them apart."""
    clip = F.coalesce("clip_id", F.lit(""))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(clip), F.lit(buckets)).cast("int")).withColumn("dataset_id", F.nullif("dataset_id", F.lit("")))


def write_table(rows: DataFrame, path: str, buckets: int) -> None:
    """Write a table anew: a folder for each dataset and bucket. A large bucket is several files."""
    laid_out(rows, buckets).write.mode("overwrite").partitionBy(*LAYOUT).parquet(path)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table with the columns of `kind` (a schema with dataset_id and clip_id), and its bucket."""
    return spark.read.schema(f"{kind}, bucket int").parquet(path)


def upsert_clips(path: str, new: DataFrame, kind: str, feature_type: str, buckets: int) -> list[tuple[str, int]]:
    """Replace the records of a type of new's (dataset_id, clip_id) by new; returns the (dataset, bucket) pairs rewritten.

    Only folders that hold clips of new are read and overwritten, so that all other files stay as they are. The merged rows
    are first written beside the table: a run that fails leaves each folder as it was or as it shall be, and another run
    with the same new gives the same rows. Rows of new without a clip are appended again by each run, as no clip says what
    they replace: they are an error. An empty new changes nothing. `buckets` must be the table's; pairs are at most as many
    as its folders.
    """
    spark = new.sparkSession
    placed = laid_out(new, buckets)
    if not placed.filter("coalesce(clip_id, '') = ''").isEmpty():
        raise ValueError("records to put in must name their clip")
    touched = [tuple(r) for r in placed.select(*LAYOUT).distinct().orderBy(*LAYOUT).collect()]
    if not touched:
        return []
    where = None
    for dataset in {d for d, _ in touched}:
        one = F.col("dataset_id").eqNullSafe(F.lit(dataset).cast("string")) & F.col("bucket").isin([b for d, b in touched if d == dataset])
        where = one if where is None else where | one
    old = read_table(spark, path, kind).filter(where)  # on folders' names: no other folder is listed for reading
    columns = [c for c in placed.columns if c not in LAYOUT] + LAYOUT
    of_type = F.coalesce(F.col("feature_type") == feature_type, F.lit(False))
    clips = placed.select(F.col("dataset_id").alias("_d"), F.col("clip_id").alias("_c")).distinct()
    kept = old.filter(~of_type).unionByName(old.filter(of_type).join(clips, F.expr("dataset_id <=> _d AND clip_id = _c"), "left_anti"))
    staged = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    kept.select(*columns).unionByName(placed.select(*columns)).write.parquet(staged)
    merged = spark.read.parquet(staged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)
    return touched
