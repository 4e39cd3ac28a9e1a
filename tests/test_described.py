"""Descriptors and mapping specs as data: odd documents, nulls, repeats, empty tables, clashing paths."""

import json

import pytest

from earshot.operators import descriptors, specs
from earshot.sources import readers

CELLS = "resource string, row_key long, field string, value string"


def described(spark, cells, docs, headers=None):
    rows = spark.createDataFrame([(r, d if isinstance(d, str) or d is None else json.dumps(d)) for r, d in docs.items()], "resource string, value string")
    have = headers if headers is not None else sorted({(c[0], c[2]) for c in cells})
    found = descriptors.described_findings(spark.createDataFrame(cells, CELLS), spark.createDataFrame(have, "resource string, field string"), rows)
    return sorted((r.resource, r.row_key or 0, r.field, r.rule) for r in found.collect())


def test_rules_of_odd_descriptors(spark):
    a = {"primaryKey": ["id", "part"], "fields": [{"name": "id", "type": "integer"}, {"name": "part"}, {"name": "up", "type": "integer", "constraints": {"enum": ["1", 2]}}, {"name": "n", "type": "number", "constraints": {"minimum": 0.5, "unique": True}}],
         "foreignKeys": [{"fields": "up", "reference": {"resource": "", "fields": "id"}}, {"fields": ["id", "part"], "reference": {"resource": "x", "fields": ["id", "part"]}}]}
    cells = [("a", 1, "id", "1"), ("a", 1, "part", None), ("a", 1, "up", "2"), ("a", 1, "n", "0.5d"), ("a", 2, "id", "1"), ("a", 2, "part", "p"), ("a", 2, "up", "01"), ("a", 2, "n", "0.1"), ("a", 3, "n", "0.1"), ("a", 3, "id", "x"), ("a", 3, "part", "p"), ("a", 3, "up", None)]
    cells += [("b", 9, "id", "anything"), ("c", 9, "z", None)]
    got = described(spark, cells, {"a": a, "b": "no JSON", "c": None, "d": {"fields": [{"name": "lost", "constraints": {"required": True}}]}})
    assert got == [("a", 1, "n", "type"), ("a", 1, "part", "required"), ("a", 1, "up", "foreign_key"), ("a", 2, "n", "minimum"), ("a", 2, "up", "foreign_key"), ("a", 3, "id", "type"), ("a", 3, "n", "minimum"), ("a", 3, "n", "unique"),
                   ("b", 0, "id", "extra_column"), ("c", 0, "z", "extra_column"), ("d", 0, "lost", "missing_column")]
    assert described(spark, [], {"a": a}, [("a", f) for f in ("id", "part", "up", "n")]) == []


def test_thousands_of_fields_are_one_plan(spark):
    docs = {"wide": {"fields": [{"name": f"f{i}", "type": "integer", "constraints": {"maximum": i}} for i in range(3000)]}}
    cells = [("wide", i, f"f{i}", str(i + i % 2)) for i in range(3000)]
    assert described(spark, cells, docs) == sorted(("wide", i, f"f{i}", "maximum") for i in range(1, 3000, 2))


def mapping(source, target, rule=None, transformation="direct_mapping", **more):
    return {"original_field": source, "mosaiq_field": target, "missingness_rule": rule, "transformation": transformation} | more


def test_specs_of_odd_rows(spark):
    docs = [{"dataset_id": "a", "mappings": [mapping("x", "p.x", "error if absent"), mapping("t", "p.t", "not_reported if absent"), mapping("n", "q", None), mapping("y", "z", None, "unheard", required=True)]},
            {"dataset_id": "clash", "mappings": [mapping("x", "p"), mapping("t", "p.t")]}, {"dataset_id": "none", "mappings": []}]
    table = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",), (None,)], "value string")
    rows = [("a", "1", {"x": "1", "t": 'say "é"\n', "n": "2.50"}, {"x": "number", "n": "number"}), ("a", "1", {"x": None}, {}), ("clash", "2", {"x": "1"}, {}), ("none", "3", {}, {}), ("lost", "4", {"x": "1"}, {})]
    frame = spark.createDataFrame(rows, "dataset_id string, row_key string, cells map<string,string>, kinds map<string,string>")
    got = sorted((r.dataset_id, r.record, sorted(map(tuple, r.missing)), sorted(map(tuple, r.errors))) for r in specs.apply_specs(frame, table).filter("dataset_id = 'a'").collect())
    assert got == sorted([("a", '{"p":{"x":1,"t":"say \\"é\\"\\n"},"q":2.50}', [], [("z", "absent"), ("z", "transformation unheard")]),
                          ("a", '{"p":{"x":null,"t":null},"q":null}', [("p.t", "not_reported", "not_reported if absent"), ("q", "unknown", "")], [("p.x", "absent"), ("z", "absent"), ("z", "transformation unheard")])])
    clash = specs.apply_specs(frame, table).filter("dataset_id = 'clash'").collect()[0]
    assert clash.record is None and ("", "clashing paths") in map(tuple, clash.errors)
    assert sorted(r.dataset_id for r in specs.unmapped(frame, table).collect()) == ["lost", "none"]
    assert specs.apply_specs(frame.limit(0), table).collect() == [] and specs.apply_specs(frame, table.limit(0)).collect() == []


def test_records_are_laid_out_once_a_spec(spark):
    docs = [{"dataset_id": "a", "mappings": [mapping("x", "b.c"), mapping("t", "d"), mapping("n", "b.e.f"), mapping(None, "b.\"g"), mapping("x", "h", transformation="none")]}, {"dataset_id": "odd", "mappings": [mapping("x", "h", transformation="none")]}]
    table = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    frame = spark.createDataFrame([(d, "1", {"x": "}}", "t": '"}', "n": "\u00e9/\t"}, {}) for d in ("a", "odd")], "dataset_id string, row_key string, cells map<string,string>, kinds map<string,string>")
    out = specs.apply_specs(frame, table)
    got = {r.dataset_id: r.record for r in out.collect()}
    assert got == {"a": '{"b":{"c":"}}","e":{"f":"\u00e9/\\t"},"\\"g":null},"d":"\\"}"}', "odd": "{}"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") > plan.index("Join")


def test_class_maps(spark):
    docs = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    found = readers.class_map(docs('{"version": 2, "groups": {"green": ["tree"]}, "aliases": null}'))
    assert (found.version, found.groups, found.aliases) == ("2", {"green": ["tree"]}, {})
    for bad in ([], ["{}", "{}"], ["[]"], ['{"groups": {"a": "b"}}'], ['{"aliases": {"a": 1}}'], ["{broken"]):
        with pytest.raises(ValueError):
            readers.class_map(docs(*bad))
