"""Graphs of records: nodes merged by id, what contradicts itself, and all that a record derives from."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.tables import shared_folder


def declared_nodes(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """id, type, n: how many rows of df declare an id with a type, by (type, column); null ids declare nothing. Counts
    precede the shuffle."""
    ends = F.array(*[F.struct(F.col(c).cast("string").alias("id"), F.lit(kind).alias("type")) for kind, c in columns])
    return df.select(F.explode(ends).alias("e")).select("e.*").filter("id IS NOT NULL").groupBy("id", "type").agg(F.count("*").alias("n"))


def merged_nodes(declared: DataFrame) -> DataFrame:
    """id, type, n_types, n: one node for each id of declared_nodes(). Its type is the one that most rows declare, of several
    such the smallest; more than one type is a conflict."""
    first = F.min(F.struct((-F.col("n")).alias("_less"), "type")).alias("_first")
    return declared.groupBy("id").agg(first, F.count("*").alias("n_types"), F.sum("n").alias("n")).select("id", F.col("_first.type").alias("type"), "n_types", "n")


def conflicts(declared: DataFrame) -> DataFrame:
    """id, type, kept, n: every type of an id that has several, whether the merged node keeps it, and its rows."""
    several = merged_nodes(declared).filter("n_types > 1").select("id", F.col("type").alias("_kept"))
    return declared.join(several, "id").select("id", "type", (F.col("type") == F.col("_kept")).alias("kept"), "n")


def ancestors(edges: DataFrame) -> DataFrame:
    """child, ancestor, steps of edges(child, parent): all that a child derives from, by the fewest steps.

    Paths double: a shortest path of more than 2^k and at most 2^(k+1) steps is one of exactly 2^k, followed by one of at
    most 2^k, so k rounds join only the former with all paths. Each round is written in the shared folder, and ends the work
    when it holds no path of its full length. In a cycle, a child is its own ancestor. Edges with a null end are none;
    repeated ones count once; no edges give no rows. The result grows with the pairs, not with the paths.
    """
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/ancestors-{uuid.uuid4().hex}"

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    own = edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor")).distinct()
    paths, k = written(own.withColumn("steps", F.lit(1).cast("long")), 0), 0
    while not paths.filter(F.col("steps") == 1 << k).isEmpty():
        full = paths.filter(F.col("steps") == 1 << k).select("child", F.col("ancestor").alias("_middle"), F.col("steps").alias("_so_far"))
        further = full.join(paths.withColumnRenamed("child", "_middle"), "_middle").select("child", "ancestor", (F.col("_so_far") + F.col("steps")).alias("steps"))
        k += 1
        paths = written(paths.unionByName(further).groupBy("child", "ancestor").agg(F.min("steps").alias("steps")), k)
    return paths
