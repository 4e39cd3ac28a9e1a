"""Documents that are dear by the row are dealt to many tasks, however few tasks read the rows that they come from."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from earshot.operators import samples
from earshot.plans.base import QUERIES
from earshot.sources import documents
from earshot.sources.surveys import table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,parts", [("r36_mapping_findings", 1), ("b13_validation_totals", 4), ("b08_flattened_ratings", 1), ("b08_flattened_clips", 1), ("b07_catalogue", 1)])
def test_one_file_is_dealt(spark, name, parts):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("RoundRobinPartitioning") >= parts


def test_documents_are_spread(spark):
    rows = documents.documents_of(table(spark, SF, "customer"), F.col("c_custkey"), documents.MAPPINGS)
    held = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 8 and max(r["count"] for r in held) < 4 * rows.count() / len(held) + 4


def test_odd_mapping_specs(spark):
    texts = ['{"mappings":[5,null,[1],{}],"dataset_id":7}', '{"mappings":{"a":1},"semantic_framework":"ISO_12913","harmonisation_scope":"schema_level"}', "[1]", None, '{"mappings":[{"source_column_examples":"[1]","mapping_confidence":["high"]}]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key long, value string")
    got = {}
    for f in samples.mapping_findings(docs).collect():
        got.setdefault((f.row_key, f.record_id), []).append((f.rule, f.part))
    every = ",".join(sorted(samples.MAPPING_FIELDS))
    assert sorted(p for r, p in got[0, "7"] if r == "R37_fields") == [f"{i}:{every}" for i in range(1, 5)]
    assert sorted(p for r, p in got[0, "7"] if r == "R37_examples") == ["1", "2", "3", "4"] and sum(r == "R38" for r, _ in got[0, "7"]) == 8
    assert got[1, "1"] == [("R36_list", "mappings")]
    assert sorted(got[2, "2"]) == sorted(got[3, "3"]) == [("R36_framework", "semantic_framework"), ("R36_list", "mappings"), ("R36_scope", "harmonisation_scope")]
    assert ("R37_examples", "1") in got[4, "4"] and ("R37_confidence", "1") in got[4, "4"]


def test_sample_records_are_read_once_and_not_copied_into_maps(spark):
    plan = plan_of(QUERIES["r01_sample_findings"](spark, SF))
    assert plan.count("RoundRobinPartitioning") == 1 and plan.count("parseJson") == 1
    assert "MapType(StringType,VariantType" not in plan


@pytest.mark.parametrize("name", ["b08_flattened_ratings", "b08_flattened_clips"])
def test_nested_records_are_parsed_once(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("parseJson") == 1


@pytest.mark.parametrize("name", ["r01_sample_findings", "r36_mapping_findings", "b13_validation_totals"])
def test_rules_are_computed_once_before_the_explode(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "explode(_found" in plan and "explode(flatten" not in plan
    assert not [line for line in plan.split("\n") if "Filter" in line and "flatten" in line]
