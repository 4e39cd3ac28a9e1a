"""Cells, records and streams on small tables: nulls, blanks, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from earshot.functions import texts
from earshot.operators import harmonise, records
from earshot.operators.checks import Field
from earshot.streaming.rules import checked_stream


def test_cells_that_do_not_parse_are_null(spark):
    rows = spark.createDataFrame([(None,), ("",), (" -2.7 ",), ("nan",), ("x9",), ("1.4 MB",)], "c string")
    c = F.col("c")
    got = rows.select(texts.number(c), texts.whole_number(c), texts.first_integer(c), texts.size_bytes(c), texts.present(c)).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, None), (None, None, None, None, None), (-2.7, -2, 2, None, " -2.7 "), (None, None, None, None, None), (None, None, 9, None, "x9"), (None, None, 1, 1_400_000, "1.4 MB")]


def test_findings_of_nulls_repeats_and_empty_tables(spark):
    kind = "row_key long, feature_id string, clip_id string, feature_type string, provenance_json string, feature_value_json string"
    clips = spark.createDataFrame([("a",), ("a",), (None,)], "clip_id string")
    rows = [(1, "f", "a", "other", '{"t":1}', None), (2, "f", "b", "odd", "{", "[]"), (3, None, None, None, None, None)]
    found = records.record_findings(spark.createDataFrame(rows, kind), clips, records.STRICT_TYPES)
    assert sorted((r["row_key"], r["rule"]) for r in found.collect()) == [(2, "F02"), (2, "F04"), (2, "F05"), (2, "F07"), (2, "F09"), (3, "F01"), (3, "F03"), (3, "F05"), (3, "F06")]
    assert records.record_findings(spark.createDataFrame([], kind), clips, records.STRICT_TYPES).count() == 0


def test_paths_are_below_the_datasets_folder(spark):
    kind = "row_key long, feature_id string, clip_id string, feature_type string, provenance_json string, feature_value_json string, feature_path string"
    rows = [(1, "a", "c", "other", "{}", "", "x.npy"), (2, "b", "c", "other", "{}", "", "/data/set/x.npy"), (3, "d", "c", "other", "{}", "", "y.npy"), (4, "e", "c", "other", "{}", "", "/x.npy"), (5, "f", "c", "other", "{}", "", " ")]
    files = spark.createDataFrame([("/data/set/x.npy",), ("y.npy",)], "path string")
    clips = spark.createDataFrame([("c",)], "clip_id string")
    found = lambda folder: sorted((r.row_key, r.part) for r in records.record_findings(spark.createDataFrame(rows, kind), clips, records.STRICT_TYPES, files, folder).filter("rule = 'F10'").collect())
    assert found("/data/set/") == [(3, "y.npy"), (4, "/x.npy")] and found("") == [(1, "x.npy"), (4, "/x.npy")]


def test_mapping_paths_must_not_clash():
    with pytest.raises(ValueError):
        harmonise.nested([("a", "x.y"), ("b", "x.y")])


def test_stream_parts_good_rows_from_findings(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "k long, v double").write.parquet(source)
    stream = spark.readStream.schema("k long, v double").parquet(source)
    fields = [Field("v", required=True, maximum=10)]
    checked_stream(stream, "k", fields, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "at")).awaitTermination(120)
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert sorted((r["row_key"], r["rule"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [(2, "maximum"), (3, "required")]


def test_loose_edges_of_nulls_repeats_and_empty_tables(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "C"), (None, "A")], "id string, type string")
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "x"), ("a", "r", "x"), (None, "r", "b"), ("y", "r", None), ("z", "s", "z")], "source string, relation string, target string")
    got = sorted(map(str, (tuple(r) for r in harmonise.loose_edges(nodes, edges).collect())))
    want = [("a", "r", "x", "target")] * 2 + [(None, "r", "b", "source"), ("y", "r", None, "source"), ("y", "r", None, "target"), ("z", "s", "z", "source"), ("z", "s", "z", "target")]
    assert got == sorted(map(str, want))
    assert harmonise.loose_edges(nodes.limit(0), edges).count() == 12 and harmonise.loose_edges(nodes, edges.limit(0)).count() == 0


def test_only_loose_edges_are_shuffled(spark):
    nodes, edges = harmonise.graph(spark.range(90).selectExpr("id AS a", "id % 9 AS b"), [("A", "a", "r", "B", "b")])
    plan = harmonise.loose_edges(nodes.filter("id <> 'B:3'"), edges)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" in plan  # edges meet the few loose ends, not all nodes
    side = plan[: plan.index("LeftSemi")]
    assert "Exchange" in side and plan.count("Exchange hashpartitioning") == 2
