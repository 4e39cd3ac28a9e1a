"""Queries of package validation: raw text tables with planted faults, and the SQL that finds the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earshot.operators import checks
from earshot.operators.checks import Field, Resource
from earshot.operators.tables import shared_folder
from earshot.plans.base import query
from earshot.sources.surveys import table

CLIPS = """SELECT c_custkey AS row_key, CASE c_custkey % 11 WHEN 3 THEN '' WHEN 4 THEN 'bad id' WHEN 5 THEN 'C5' ELSE concat('C', c_custkey) END AS clip_id,
concat('N', c_nationkey) AS place, CASE c_custkey % 7 WHEN 1 THEN 'x' WHEN 2 THEN '9' WHEN 3 THEN '-1' WHEN 4 THEN '' WHEN 5 THEN '2.0' ELSE '4' END AS fold,
CASE c_custkey % 5 WHEN 0 THEN '4.5' WHEN 1 THEN '91' WHEN 2 THEN 'north' WHEN 3 THEN NULL ELSE '-90.5' END AS latitude,
CASE c_custkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'yes' WHEN 2 THEN '' ELSE 'false' END AS shared,
CASE c_custkey % 4 WHEN 0 THEN concat('https://example.org/', c_custkey) WHEN 1 THEN 'no link' WHEN 2 THEN '' ELSE 'mailto:a' END AS link,
CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'Dev' END AS split, c_mktsegment AS segment FROM customer"""
FIELDS = [
    Field("clip_id", "string", pattern="[A-Za-z0-9_]+"), Field("place", "string", required=True), Field("fold", "integer", enum=(-1, 0, 1, 2, 3, 4, 5, 6, 7)),
    Field("latitude", "number", required=True, minimum=-90, maximum=90), Field("shared", "boolean"), Field("link", "string", format="uri"),
    Field("split", "string", enum=("train", "test", "dev", "aux")), Field("recorder", "string"),
]
NATIONS = "SELECT n_nationkey AS row_key, CASE WHEN n_nationkey % 9 = 8 THEN '' ELSE concat('N', n_nationkey) END AS place, n_name AS name FROM nation"

_PLAIN = f"""c AS ({CLIPS}), n AS ({NATIONS}), typed AS (SELECT *, nullif(clip_id, '') AS id, CASE WHEN regexp_full_match(fold, '[+-]?[0-9]+') THEN fold::BIGINT END AS f, try_cast(latitude AS DOUBLE) AS lat FROM c),
firsts AS (SELECT id, min(row_key) AS first FROM typed WHERE id IS NOT NULL GROUP BY id),
found AS (SELECT 'clips' AS resource, NULL::BIGINT AS row_key, 'recorder' AS field, 'missing_column' AS rule UNION ALL SELECT 'clips', NULL, 'segment', 'extra_column'
UNION ALL SELECT 'clips', row_key, 'clip_id', 'required' FROM typed WHERE id IS NULL
UNION ALL SELECT 'clips', row_key, 'clip_id', 'pattern' FROM typed WHERE NOT regexp_full_match(id, '[A-Za-z0-9_]+')
UNION ALL SELECT 'clips', row_key, 'clip_id', 'unique' FROM typed JOIN firsts USING (id) WHERE row_key > first
UNION ALL SELECT 'clips', row_key, 'fold', 'type' FROM typed WHERE fold <> '' AND f IS NULL
UNION ALL SELECT 'clips', row_key, 'fold', 'enum' FROM typed WHERE f NOT BETWEEN -1 AND 7
UNION ALL SELECT 'clips', row_key, 'latitude', 'required' FROM typed WHERE coalesce(latitude, '') = ''
UNION ALL SELECT 'clips', row_key, 'latitude', 'type' FROM typed WHERE latitude <> '' AND lat IS NULL
UNION ALL SELECT 'clips', row_key, 'latitude', 'minimum' FROM typed WHERE lat < -90 UNION ALL SELECT 'clips', row_key, 'latitude', 'maximum' FROM typed WHERE lat > 90
UNION ALL SELECT 'clips', row_key, 'shared', 'type' FROM typed WHERE shared NOT IN ('', 'true', 'True', 'TRUE', '1', 'false', 'False', 'FALSE', '0')
UNION ALL SELECT 'clips', row_key, 'link', 'format' FROM typed WHERE link <> '' AND NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:')
UNION ALL SELECT 'clips', row_key, 'split', 'enum' FROM typed WHERE split NOT IN ('train', 'test', 'dev', 'aux')
UNION ALL SELECT 'clips', row_key, 'place', 'foreign_key' FROM typed WHERE place NOT IN (SELECT place FROM n)
UNION ALL SELECT 'places', row_key, 'place', 'required' FROM n WHERE place = '')"""


def package(spark, sf_dir) -> list[Resource]:
    clips = spark.sql(CLIPS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    places = spark.sql(NATIONS.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))
    return [Resource("clips", clips, "row_key", FIELDS, "clip_id", (("place", "places", "place"),)),
            Resource("places", places, "row_key", [Field("place", "string"), Field("name", "string", required=True)], "place")]


@query(f"WITH {_PLAIN} SELECT * FROM found")
def v04_package_findings(spark, sf_dir):
    """Types, required and unique values, ranges, enumerations of texts and integers, patterns, links, keys, headers."""
    return checks.package_findings(package(spark, sf_dir))


@query(f"WITH {_PLAIN} SELECT 'survey' AS package, r AS resource, count(found.resource) AS findings, count(found.resource) = 0 AS valid FROM (VALUES ('clips'), ('places')) l(r) LEFT JOIN found ON found.resource = r GROUP BY r")
def v12_package_roll_up(spark, sf_dir):
    """Whether each table of the package is valid."""
    resources = package(spark, sf_dir)
    return checks.roll_up("survey", resources, checks.package_findings(resources))


@query(f"WITH {_PLAIN} SELECT 'survey' AS package, r AS resource, count(found.resource) AS findings, count(found.resource) = 0 AS valid, (SELECT count(*) FROM found) AS written FROM (VALUES ('clips'), ('places')) l(r) LEFT JOIN found ON found.resource = r GROUP BY r")
def v12_written_roll_up(spark, sf_dir):
    """The roll-up of findings that are written, counted while they are."""
    resources, path = package(spark, sf_dir), f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    n = checks.written_with_counts(checks.package_findings(resources), path, {r.name: F.col("resource") == r.name for r in resources})
    written = spark.read.parquet(path).agg(F.count("*").alias("written"))  # one row
    rows = F.array(*[F.struct(F.lit("survey").alias("package"), F.lit(r.name).alias("resource"), F.lit(n[r.name]).cast("long").alias("findings"), F.lit(n[r.name] == 0).alias("valid")) for r in resources])
    return written.select("written", F.explode(rows).alias("r")).select("r.*", "written")


@query("SELECT 'clips' AS resource, field, rule, n FROM (SELECT 'fold' AS field, 'enum' AS rule, count(*) FILTER (c_custkey % 7 = 2) AS n FROM customer UNION ALL SELECT 'split', 'enum', count(*) FILTER (c_custkey % 3 = 2) FROM customer)")
def v07_enumerations(spark, sf_dir):
    """How many values of each enumerated field of the clips are none of its values."""
    clips = package(spark, sf_dir)[0]
    listed = [f for f in clips.fields if f.enum]
    counts = [F.count_if(dict(f.broken())["enum"]).alias(f.name) for f in listed]
    return clips.rows.agg(*counts).unpivot([], [f.name for f in listed], "field", "n").select(F.lit("clips").alias("resource"), "field", F.lit("enum").alias("rule"), "n")


@query("SELECT f AS field, k AS kind, p AS position, (SELECT count(*) FROM customer) AS n_rows FROM (VALUES ('clip_id', 'string', 1::BIGINT), ('place', 'string', 2), ('fold', 'integer', 3), ('latitude', 'number', 4), ('shared', 'boolean', 5)) t(f, k, p)")
def v13_first_fields(spark, sf_dir):
    """The first five fields of the clips' schema beside the table's row count."""
    clips = package(spark, sf_dir)[0]
    fields = checks.described(spark, "survey", [clips]).filter("position <= 5")
    return spark.sql("SELECT field, kind, position, (SELECT count(*) FROM {rows}) AS n_rows FROM {fields}", rows=clips.rows, fields=fields)
