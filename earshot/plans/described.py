"""Queries whose rules and mappings are data: descriptors and specs in files, or derived from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from earshot.functions import scores
from earshot.operators import descriptors, records, specs
from earshot.operators.tables import shared_folder
from earshot.plans import packages
from earshot.plans.base import query
from earshot.sources import readers, surveys
from earshot.sources.surveys import FRAMES_SQL, PLACES_SQL, STIMULUS_SQL, table


def files_of(spark, documents: dict[str, dict]):
    """Documents written as files of their own and read again: file, value."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    for name, doc in documents.items():
        spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return spark.read.text([f"{folder}/{n}" for n in documents], wholetext=True).select(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1).alias("resource"), "value")


# The clips and places of earshot.plans.packages, declared in JSON.
DESCRIBED = {
    "clips": {
        "primaryKey": "clip_id",
        "fields": [
            {"name": "clip_id", "type": "string", "constraints": {"pattern": "[A-Za-z0-9_]+"}}, {"name": "place", "type": "string", "constraints": {"required": True}},
            {"name": "fold", "type": "integer", "constraints": {"enum": [-1, 0, 1, 2, 3, 4, 5, 6, 7]}}, {"name": "latitude", "type": "number", "constraints": {"required": True, "minimum": -90, "maximum": 90}},
            {"name": "shared", "type": "boolean"}, {"name": "link", "type": "string", "format": "uri"}, {"name": "split", "type": "string", "constraints": {"enum": ["train", "test", "dev", "aux"]}},
            {"name": "recorder", "type": "string"},
        ],
        "foreignKeys": [{"fields": ["place"], "reference": {"resource": "places", "fields": ["place"]}}],
    },
    "places": {"primaryKey": ["place"], "fields": [{"name": "place", "type": "string"}, {"name": "name", "type": "string", "constraints": {"required": True}}]},
}


@query(f"WITH {packages._PLAIN} SELECT * FROM found")
def v04_described_findings(spark, sf_dir):
    """The findings of a package whose schemas are read from files."""
    tables = {r.name: (r.rows, r.row_key) for r in packages.package(spark, sf_dir)}
    cells = [descriptors.cells_of(name, rows, key) for name, (rows, key) in tables.items()]
    return descriptors.described_findings(cells[0].unionByName(cells[1]), descriptors.headers_of(tables), files_of(spark, DESCRIBED))


_RULES = "CASE p_partkey % 5 WHEN 0 THEN '{\"maximum\":40}' WHEN 1 THEN concat('{\"minimum\":', p_size, '}') WHEN 2 THEN '{\"enum\":[\"7\",\"9\",11]}' WHEN 3 THEN '{\"pattern\":\"[1-3]?[0-9]\"}' ELSE '{\"required\":true}' END"


@query("""WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS row_key, l_partkey AS k, CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN 'few' ELSE l_quantity::INT::VARCHAR END AS v FROM lineitem),
t AS (SELECT c.*, p_size, try_cast(v AS INT) AS n FROM c JOIN part ON p_partkey = k)
SELECT 'sheet' AS resource, row_key, 'f' || k AS field, 'maximum' AS rule FROM t WHERE k % 5 = 0 AND n > 40 UNION ALL SELECT 'sheet', row_key, 'f' || k, 'minimum' FROM t WHERE k % 5 = 1 AND n < p_size
UNION ALL SELECT 'sheet', row_key, 'f' || k, 'enum' FROM t WHERE k % 5 = 2 AND n IS NOT NULL AND n NOT IN (7, 9, 11) UNION ALL SELECT 'sheet', row_key, 'f' || k, 'pattern' FROM t WHERE k % 5 = 3 AND NOT regexp_full_match(v, '[1-3]?[0-9]')
UNION ALL SELECT 'sheet', row_key, 'f' || k, 'required' FROM t WHERE k % 5 = 4 AND v IS NULL UNION ALL SELECT 'sheet', row_key, 'f' || k, 'type' FROM t WHERE k % 5 <> 3 AND v = 'few'""")
def v01_rules_of_parts(spark, sf_dir):
    """A sheet with a field for each part, every one with rules of its own, in one join."""
    field = F.expr(f"concat('{{\"name\":\"f', p_partkey, '\",\"type\":\"', CASE WHEN p_partkey % 5 = 3 THEN 'string' ELSE 'integer' END, '\",\"constraints\":', {_RULES}, '}}')")
    declared = table(spark, sf_dir, "part").select(F.lit("sheet").alias("resource"), F.concat(F.lit('{"fields":['), field, F.lit("]}")).alias("value"))
    cells = table(spark, sf_dir, "lineitem").selectExpr("'sheet' AS resource", "l_orderkey * 8 + l_linenumber AS row_key", "concat('f', l_partkey) AS field", "CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN 'few' ELSE cast(cast(l_quantity AS int) AS string) END AS value")
    headers = declared.select("resource", F.get_json_object("value", "$.fields[0].name").alias("field"))
    return descriptors.described_findings(cells, headers, declared)


def _mapping(source: str, target: str, rule: str, transformation: str = "direct_mapping", **said) -> dict:
    return {"original_field": source, "mosaiq_field": target, "transformation": transformation, "missingness_rule": rule} | said


_SAID = {"mapping_confidence": "high", "evidence_type": "metadata_file", "review_status": "proposed"}
SPECS = {
    "places": {"dataset_id": "places", "mappings": [
        _mapping("response_key", "sample_id", "error if absent", required=True, **_SAID), _mapping("location", "context.place.location", "not_reported if absent from source metadata", **_SAID),
        _mapping("session", "context.session", "not_reported if absent", **_SAID), _mapping("pleasant", "perception.pleasant", "not_accessible if withheld", "direct_mapping_from_existing_derived_value", mapping_confidence="low", evidence_type="paper", review_status="reviewed"),
        _mapping("height", "context.place.height", "not_accessible without permission", mapping_confidence="low", evidence_type="paper", review_status="proposed")]},
    "stimuli": {"dataset_id": "stimuli", "mappings": [
        _mapping("response_key", "sample_id", "error if absent", **_SAID), _mapping("masker", "audio.masker", "not_reported if absent", **_SAID),
        _mapping("calm", "perception.calm", "error if absent", **_SAID), _mapping("fold", "split", "not_reported if absent", "guessed", mapping_confidence="low", evidence_type="paper", review_status="proposed")]},
}


def _mapped_rows(spark, sf_dir):
    places = surveys.place_responses(spark, sf_dir).withColumn("key", F.concat_ws(":", "response_key"))
    stimuli = surveys.stimulus_responses(spark, sf_dir).withColumn("key", F.concat_ws(":", "response_key", "line", "part_key"))
    return specs.cells_map(places, "places", "key").unionByName(specs.cells_map(stimuli, "stimuli", "key"))


@query(f"WITH {PLACES_SQL}, {STIMULUS_SQL} SELECT 'places' AS dataset_id, response_key::VARCHAR AS row_key, to_json({{'sample_id': response_key, 'context': {{'place': {{'location': location, 'height': NULL}}, 'session': session}}, 'perception': {{'pleasant': pleasant}}}})::VARCHAR AS record, 0::INT AS errors FROM places "
       + "UNION ALL SELECT 'stimuli', concat_ws(':', response_key, line, part_key), to_json({'sample_id': response_key, 'audio': {'masker': masker}, 'perception': {'calm': calm}})::VARCHAR, 1 + CASE WHEN calm IS NULL THEN 1 ELSE 0 END FROM stimulus")
def h01_spec_records(spark, sf_dir):
    """Two datasets mapped by their own specs, read from files, in one job."""
    out = specs.apply_specs(_mapped_rows(spark, sf_dir), files_of(spark, SPECS))
    return out.select("dataset_id", "row_key", "record", F.size("errors").alias("errors"))


@query(f"WITH {PLACES_SQL}, {STIMULUS_SQL} SELECT 'places' AS dataset_id, response_key::VARCHAR AS row_key, 'context.place.location' AS field, 'not_reported' AS status, 'not_reported if absent from source metadata' AS reason FROM places WHERE location IS NULL "
       + "UNION ALL SELECT 'places', response_key::VARCHAR, 'context.place.height', 'not_accessible', 'not_accessible without permission' FROM places UNION ALL SELECT 'stimuli', concat_ws(':', response_key, line, part_key), 'perception.calm', 'error', 'absent' FROM stimulus WHERE calm IS NULL "
       + "UNION ALL SELECT 'stimuli', concat_ws(':', response_key, line, part_key), 'split', 'error', 'transformation guessed' FROM stimulus")
def h02_spec_missingness(spark, sf_dir):
    """What is missing or wrong by the rules of each spec."""
    out = specs.apply_specs(_mapped_rows(spark, sf_dir), files_of(spark, SPECS))
    wrong = F.transform("errors", lambda e: F.struct(e["field"].alias("field"), F.lit("error").alias("status"), e["reason"].alias("reason")))
    noted = out.select("dataset_id", "row_key", F.concat("missing", wrong).alias("noted"))
    return noted.select("dataset_id", "row_key", F.explode_outer("noted").alias("m")).filter("m IS NOT NULL").select("dataset_id", "row_key", "m.*")


@query(f"""WITH {PLACES_SQL}, {STIMULUS_SQL} SELECT 'high' AS mapping_confidence, 'metadata_file' AS evidence_type, 'proposed' AS review_status, 6::BIGINT AS mappings, (SELECT 2 * count(*) + count(location) FROM places) + (SELECT 2 * count(*) + count(calm) FROM stimulus) AS values
UNION ALL SELECT 'low', 'paper', 'reviewed', 1, (SELECT count(*) FROM places) UNION ALL SELECT 'low', 'paper', 'proposed', 2, (SELECT count(*) FROM stimulus)""")
def h11_spec_audit(spark, sf_dir):
    """Mappings by what reviewers said, and how many values they carry."""
    return specs.audit(files_of(spark, SPECS), _mapped_rows(spark, sf_dir))


CLASSES = {"version": "1", "taxonomy": "events", "groups": {"active": ["interaction", "purchase"], "done": ["purchase", "signup"], "none": []}, "aliases": {"click": "interaction", "view": "interaction"}}


@query(f"WITH {FRAMES_SQL}, c AS (SELECT clip, CASE WHEN class_name IN ('click', 'view') THEN 'interaction' ELSE class_name END AS class_name, cents FROM frames) SELECT clip, g AS group_name, coalesce(sum(cents) FILTER (list_contains(m, class_name)), 0)::BIGINT AS cents FROM c, (VALUES ('active', ['interaction', 'purchase']), ('done', ['purchase', 'signup']), ('none', [])) t(g, m) GROUP BY clip, g")
def s13_class_map(spark, sf_dir):
    """Shares summed by the groups of a class map that is read from a file."""
    known = readers.class_map(files_of(spark, {"classes": CLASSES}))
    named = scores.canonical_class(F.col("class_name"), known.aliases)
    return records.group_sums(records.class_sums(surveys.frames(spark, sf_dir), named, ["clip"]), known.groups)
