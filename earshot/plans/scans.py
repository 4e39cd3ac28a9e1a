"""Queries that write a given table in a survey's file formats below the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.operators.tables import shared_folder
from earshot.plans.base import query
from earshot.sources import packed, readers
from earshot.sources.surveys import table

CELLS = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'a "quoted", cell' WHEN 3 THEN 'None' ELSE c_name END AS name,
CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'ten' WHEN 2 THEN ' 2.5 ' WHEN 3 THEN 'nan' ELSE cast(c_nationkey AS string) END AS score FROM customer"""


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT id, CASE WHEN name IN ('', 'NA', 'None') THEN NULL ELSE name END AS name, try_cast(nullif(trim(score), 'nan') AS DOUBLE) AS score, trunc(try_cast(nullif(trim(score), 'nan') AS DOUBLE))::BIGINT AS whole FROM ({CELLS.replace('AS string', 'AS VARCHAR')})")
def s01_typed_csv(spark, sf_dir):
    """Cells typed by kind, those that count as missing null."""
    path = _folder(spark, "cells")
    rows = spark.sql(CELLS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    readers.write_csv(rows, path, ["id", "name", "score"])
    back = readers.csv_typed(spark, path, {"id": "integer", "name": "string", "score": "number"})
    return back.select("id", "name", "score", F.col("score").cast("long").alias("whole"))


@query("SELECT s_suppkey, s_name FROM supplier")
def s07_json_lines(spark, sf_dir):
    """Lines of JSON written, blank ones among them, and read again."""
    path = _folder(spark, "lines")
    rows = table(spark, sf_dir, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name")).alias("value"))
    blank = table(spark, sf_dir, "nation").select(F.lit("  ").alias("value"))
    rows.unionByName(blank).write.text(path)
    return readers.json_lines(spark, path, "*.txt").select(F.from_json("value", "s_suppkey long, s_name string").alias("r")).select("r.*")


@query("SELECT c_custkey, true AS numbered FROM customer")
def s07_line_numbers(spark, sf_dir):
    """Lines of files, each followed by a blank one and holding its own number, which the reader must find."""
    path = _folder(spark, "numbered")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the file that a task writes
    rows = table(spark, sf_dir, "customer").repartition(5, "c_custkey").select("c_custkey", (2 * place + 1).alias("line"))
    rows.select(F.concat(F.to_json(F.struct("c_custkey", "line")), F.lit("\n"))).write.text(path)
    found = readers.json_lines(spark, path, "*.txt").select("line", F.from_json("value", "c_custkey long, line long").alias("r"))
    return found.select("r.c_custkey", (F.col("r.line") == F.col("line")).alias("numbered"))


@query("SELECT 'c' || p_partkey // 2 AS clip_id, max(p_partkey) AS frames FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1")
def s10_summary_index(spark, sf_dir):
    """Packed summaries in three shapes, of up to eight parts each; the last of a clip stays."""
    packs = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("g")).agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"))  # eight at most
    clip = lambda k: F.concat(F.lit("c"), F.floor(k / 2).cast("string"))
    entry = lambda k: F.struct(F.when(k % 11 != 0, clip(k)).alias("clip_id"), k.alias("frames"))
    listed = F.to_json(F.transform("ids", entry))
    last = F.filter("ids", lambda k: (k % 11 != 0) & ~F.exists("ids", lambda o: (o % 11 != 0) & (o > k) & (F.floor(o / 2) == F.floor(k / 2))))
    by_clip = F.to_json(F.map_from_entries(F.transform(last, lambda k: F.struct(clip(k), F.struct(k.alias("frames"))))))
    shapes = F.when(F.col("g") % 3 == 0, listed).when(F.col("g") % 3 == 1, F.concat(F.lit('{"summaries":'), listed, F.lit("}"))).otherwise(by_clip)
    index = readers.summary_index(packs.select(shapes.alias("value")))
    return index.select("clip_id", F.try_variant_get("summary", "$.frames", "bigint").alias("frames"))


@query("SELECT 'c' || p_partkey % 37 AS clip_id, max(p_partkey) AS frames FROM part GROUP BY 1")
def s10_packed_files(spark, sf_dir):
    """Documents of three shapes, each a file, read by ranges; the last entry of the last file stays. The first hundred hold
    twenty entries, all others 2,000: files that grow in number as fast as entries would measure the file system."""
    path = _folder(spark, "packed")
    own = Window.partitionBy("g").orderBy("p_partkey")  # 2,000 rows at most
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey < 2000 THEN p_partkey div 20 ELSE 100 + p_partkey div 2000 END").alias("g")).withColumn("n", F.row_number().over(own)).withColumn("most", F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    begin = "CASE WHEN n > 1 THEN ',' WHEN g % 3 = 0 THEN '[' WHEN g % 3 = 1 THEN '{\"version\":\"}\",\"summaries\":[' ELSE '{' END"
    body = "CASE WHEN g % 3 = 2 THEN concat('\"c', p_partkey % 37, '\":{') ELSE concat('{\"clip_id\":\"c', p_partkey % 37, '\",') END"
    end = "CASE WHEN n < most THEN '' WHEN g % 3 = 0 THEN ']' WHEN g % 3 = 1 THEN ']}' ELSE '}' END"
    text = f"concat({begin}, {body}, '\"notes\":[\"}}\",{{}}],\"frames\":', p_partkey, '}}', {end}) AS value"
    rows.repartition("g").sortWithinPartitions("g", "n").selectExpr("format_string('%010d', g) AS g", text).write.partitionBy("g").text(path)
    index = packed.packed_index(spark, f"{path}/*", "*.txt")
    return index.select("clip_id", F.try_variant_get("summary", "$.frames", "bigint").alias("frames"))


_ENDS = "CASE p_partkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '_summary.json' WHEN 2 THEN '.summary.csv' ELSE '.txt' END"


@query(f"""WITH f AS (SELECT 'c' || p_partkey % 60 AS clip, {_ENDS} AS ending FROM part) SELECT clip AS clip_id, clip || arg_min(ending, CASE ending WHEN '_summary.json' THEN 1 WHEN '.summary.csv' THEN 3 ELSE 5 END) AS file FROM f WHERE ending <> '.txt' GROUP BY clip""")
def s11_summary_files(spark, sf_dir):
    """The summary file of each clip that is asked for first."""
    files = table(spark, sf_dir, "part").select(F.expr(f"concat('c', p_partkey % 60, {_ENDS})").alias("file"))
    return readers.summary_files(files)


@query("SELECT 'u' || user_id AS clip_id, event_type AS class_name, coalesce(try_cast(arg_max(r, event_id) AS DOUBLE), 0) AS ratio FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE (event_id % 100)::VARCHAR END AS r FROM events) WHERE event_id % 17 <> 0 GROUP BY ALL")
def s12_class_rows(spark, sf_dir):
    """Class shares of summary tables: rows of other clips out, the last row of a class stays, bad numbers count 0."""
    rows = table(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS file_clip", "CASE WHEN event_id % 17 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN '' ELSE concat('u', user_id) END AS clip_id", "cast(NULL AS string) AS frame_id", "event_type AS class_name", "CASE WHEN event_id % 13 = 0 THEN 'x' ELSE cast(event_id % 100 AS string) END AS ratio", "event_id AS pos")
    return readers.class_rows(rows).select("clip_id", "class_name", "ratio")


@query("SELECT p_partkey AS clip_id, CASE WHEN p_partkey % 3 = 0 THEN 'data/v' || p_partkey || '.mp4' WHEN p_partkey % 3 = 1 THEN '/abs/' || p_partkey || '.mov' ELSE 'v' || p_partkey || '.avi' END AS path FROM part WHERE p_partkey % 5 <> 0")
def s18_asset_paths(spark, sf_dir):
    """The first file of each clip's asset that is there."""
    part = table(spark, sf_dir, "part")
    clips = part.selectExpr("p_partkey AS clip_id", "CASE p_partkey % 3 WHEN 0 THEN concat('v', p_partkey) WHEN 1 THEN concat('/abs/', p_partkey, '.mov') ELSE '' END AS asset", "CASE p_partkey % 3 WHEN 2 THEN concat('v', p_partkey, '.avi') END AS asset_id")
    there = part.filter("p_partkey % 5 <> 0")
    files = there.select(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('data/v', p_partkey, '.mp4') WHEN 1 THEN concat('/abs/', p_partkey, '.mov') ELSE concat('v', p_partkey, '.avi') END").alias("path"))
    return readers.asset_paths(clips, files, ["data", ""], [".mp4", ".mov"])


@query("SELECT p_size AS role, count(*) AS files, sum(p_partkey % 2)::BIGINT AS ingested FROM part GROUP BY p_size")
def s20_manifest_roles(spark, sf_dir):
    """Files of a manifest by role, and how many were ingested."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("role")).agg(F.count("*").alias("files"), F.sum(F.col("p_partkey") % 2).alias("ingested"))
