"""Sections of sample records that their texts tell to be sound are passed over; the rules decide about all others."""

import json

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from earshot.operators import samples
from earshot.plans.base import QUERIES
from earshot.sources import documents


def sure_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key long, value string")
    rows = samples.opened(samples.parsed(docs)).select("row_key", *[samples.surely_sound(g).alias(g) for g in samples.GROUPS]).collect()
    return {r["row_key"]: {g for g in samples.GROUPS if r[g]} for r in rows}


def test_only_the_sections_of_a_fault_are_looked_into(spark):
    sure = sure_groups(spark, documents.SAMPLES[: len(documents.SAMPLE_FAULTS)])
    every = set(samples.GROUPS)
    assert sure[0] == every  # the sound record
    left = {documents.SAMPLE_FAULTS[i][0]: every - groups for i, groups in sure.items()}
    assert left["harmonisation.levels.other"] == {"levels"} and left["perception.iso_12913.paq.calm.value"] == {"items"} and left["knowledge_graph.edges.0.target"] == {"graph"}
    assert all(len(groups) <= 2 for groups in left.values()) and sum(map(len, left.values())) < len(left)


def test_texts_that_look_empty_count_by_their_kind(spark):
    empty, texts = [0, 0.0, False, [], {}, "", None], ["0", "0.0", "false", "[]", "{}", "no", "null"]
    records = []
    for v in empty + texts:
        r = documents.changed(documents.sound_sample(), "harmonisation.levels.feature_harmonisation.note", v)
        r = documents.changed(documents.changed(r, "provenance.0.note", v), "visual.asset", v)
        r["knowledge_graph"]["nodes"][1]["label"] = v
        r["features"]["acoustic_indicators"][0]["method"] = v
        r["perception"]["iso_12913"]["derived_coordinates"]["pleasantness"]["method"] = v
        records.append(documents.changed(r, "sample_id", v))
    docs = spark.createDataFrame(list(enumerate(map(json.dumps, records))), "row_key long, value string")
    got = {i: set() for i in range(len(records))}
    for f in samples.sample_findings(docs, ("SURVEY",)).collect():
        got[f.row_key].add(f.rule)
    broken = {"R03", "R06_note", "R24_method", "R26_note", "R29", "R30_method", "R31_fields"}
    assert [got[i] for i in range(len(records))] == [broken] * len(empty) + [set()] * len(texts)


def test_parts_of_other_kinds_are_never_passed_over(spark):
    base = documents.sound_sample()
    records = [documents.changed(base, "provenance", [7, {"source_type": "paper", "note": "n"}]), documents.changed(base, "knowledge_graph.nodes", [None, *base["knowledge_graph"]["nodes"]]),
               documents.changed(base, "knowledge_graph.edges.0.source", None), documents.changed(base, "harmonisation_potential.components.0.score", "1"), documents.changed(base, "missingness", [[]]),
               documents.changed(base, "features.derived_features", [{"name": "x"}]), documents.changed(base, "perception.iso_12913.paq", [])]
    docs = spark.createDataFrame(list(enumerate(map(json.dumps, records))), "row_key long, value string")
    got = sorted((f.row_key, f.rule) for f in samples.sample_findings(docs).filter(F.col("severity") == "error").collect())
    assert got == [(0, "R26_object"), (1, "R31_object"), (2, "R32_ends"), (3, "R34_score"), (4, "R25_object"), (5, "R30_method")]


def test_all_kinds_mark_parts_only_where_there_are_some(spark):
    plan = QUERIES["b13_validation_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(array(CASE WHEN (size(") >= 5 and "flatten(array(transform(" not in plan
