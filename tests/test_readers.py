"""Files of surveys, builders and numbering on small tables."""

import base64
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions.scores import ITEMS
from earshot.operators import builders, checks, numbering, samples, tables
from earshot.sources import readers


def workbook(sheets):
    """A workbook of sheets {name: xml of rows}, with two shared texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        for i, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_are_read_by_sheet(spark, tmp_path):
    head = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Last</t></is></c></row>'
    body = '<row><c r="B2"><v>2.5</v></c><c r="AA2" t="s"><v>1</v></c></row><row><c r="A3" t="b"><v>1</v></c></row><row/>'
    (tmp_path / "a.xlsx").write_bytes(workbook({"First": head, "Main": head + body}))
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    rows = {r["row"]: r["cells"] for r in readers.workbooks(spark, str(tmp_path), "Main").collect()}
    assert rows == {0: ["Name", "", "Last"], 1: ["", "2.5", *[""] * 24, "two runs"], 2: ["True"], 3: []}
    assert readers.workbooks(spark, str(tmp_path)).count() == 1
    named = readers.with_header(readers.workbooks(spark, str(tmp_path), "Main"), ["name", "value", "more"]).orderBy("row").collect()
    assert [(r["name"], r["value"], r["more"]) for r in named] == [("", "2.5", ""), ("True", "", ""), ("", "", "")]


def test_csv_cells_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "hi", ok', None), ("b", "two\nlines", "3")], "id string, text string, n string")
    path = str(tmp_path / "out")
    readers.write_csv(rows.withColumn("more", F.lit(1)), path, ["id", "text", "n", "gone"])
    assert sorted(map(tuple, readers.csv_texts(spark, path, ["id", "text", "n", "gone"]).collect())) == [("a", 'say "hi", ok', "", ""), ("b", "two\nlines", "3", "")]
    assert readers.csv_texts(spark, str(tmp_path / "nothing"), ["id"]).count() == 0


def test_sources_of_input(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.csv").write_text("a\n1\n")
    assert readers.first_path(spark, str(tmp_path), "x.csv") == f"{tmp_path}/data/x.csv"
    with pytest.raises(FileNotFoundError, match="datav2/y.csv"):
        readers.first_path(spark, str(tmp_path), "y.csv")
    assert readers.one_source(zip=None, folder="f") == ("folder", "f")
    for options in ({"zip": None, "folder": None}, {"zip": "a", "folder": "b"}):
        with pytest.raises(ValueError):
            readers.one_source(**options)


def test_lines_of_a_folder(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a":1}\n\n  \n{"a":2}\n')
    (tmp_path / "a.jsonl").write_text('{"a":3}\n')
    (tmp_path / "c.txt").write_text("no\n")
    assert sorted(map(tuple, readers.json_lines(spark, str(tmp_path)).collect())) == [("a.jsonl", 1, '{"a":3}'), ("b.jsonl", 1, '{"a":1}'), ("b.jsonl", 4, '{"a":2}')]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "w.json").write_text('{\n"x": 1}')
    assert readers.json_documents(spark, str(tmp_path / "d")).collect()[0]["value"] == '{\n"x": 1}'


def test_vectors_are_base64_of_their_bytes(spark):
    clips = spark.createDataFrame([("a",), ("b",), ("c",)], "clip_id string")
    vectors = spark.createDataFrame([("a", [0.5, -1.25, 3e9]), ("b", None)], "clip_id string, embedding array<double>")
    made, lost = builders.embedding_records(clips, vectors, "ViT-L/14")
    row = made.collect()[0]
    assert np.frombuffer(base64.b64decode(row.embedding_base64), "<f4").tolist() == [0.5, -1.25, 3e9] and row.model_name == "ViT-L-14"
    assert [r.clip_id for r in lost.collect()] == ["c"]
    with pytest.raises(ValueError):
        builders.embedding_records(clips, vectors, "m", missing="raise")


def test_repeats_are_numbered_past_a_hundred(spark):
    rows = [(i, "hot" if i < 150 else f"id{i}") for i in range(200)] + [(300, None), (301, None)]
    got = {r["k"]: r["unique"] for r in numbering.suffix_repeats(spark.createDataFrame(rows, "k long, id string"), "id", ["k"], "unique").collect()}
    assert [got[i] for i in range(150)] == [f"hot_R{i:02d}" for i in range(150)] and got[160] == "id160" and got[300] is None
    assert numbering.suffix_repeats(spark.createDataFrame([], "k long, id string"), "id", ["k"], "unique").collect() == []


def test_numbers_match_a_sort_and_compute_their_input_once(spark):
    kinds, shares = [None, "a", "b", "hot", "é"], [None, 1.5, -2.0, 0.0]
    rows = [(kinds[3 if i % 3 else i % 5], shares[i * 7 % 4], i) for i in range(2000)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, "a string, b double, i long").mapInPandas(counted, "a string, b double, i long")
    got = sorted(numbering.dense_numbers(df, ["a", "b"]).collect(), key=lambda r: r.number)
    place = lambda a, b: (a is None, a or "", b is None, b or 0.0)
    assert [r.number for r in got] == list(range(1, 2001)) and read.value == 2000
    assert [place(r.a, r.b) for r in got] == sorted(place(a, b) for a, b, _ in rows)
    again = numbering.dense_numbers(df, ["a", "b"], once=False)
    assert sorted(r.number for r in again.collect()) == list(range(1, 2001)) and again.columns == ["a", "b", "i", "number"]
    assert numbering.dense_numbers(df.limit(0), ["a"]).collect() == []


def test_freed_tables_are_gone(spark):
    table = tables.saved(spark.range(5).toDF("n"))
    assert table.count() == 5 and os.path.isdir(table._earshot_table.removeprefix("file:"))
    tables.free(table)
    tables.free(spark.range(1))
    assert not os.path.exists(table._earshot_table.removeprefix("file:"))


def test_both_outputs_read_one_table(spark):
    clean = {i: 3.0 for i in ITEMS}
    made = [{"response_key": k, "line": 1, "participant": p, "fold": f, "soundscape": "R1", "masker": None, "smr": 0, **clean} for k, (p, f) in enumerate([(1, 0), (1, 0), (2, 5), (None, 5)])]
    kind = "response_key long, line long, participant long, fold long, soundscape string, masker string, smr long, " + ", ".join(f"{i} double" for i in ITEMS)
    people = spark.createDataFrame([(1, "en")], "participant long, language string")
    announced = spark.createDataFrame([(0, "R1", None, 0), (7, "R9", "quiet", 0)], "fold long, soundscape string, masker string, smr long")
    responses, clips = builders.stimulus_tables(spark.createDataFrame(made, kind), people, announced, "S_")
    assert set(responses.inputFiles()) < set(clips.inputFiles())  # the shared table, and that of numbers
    assert not any(kind in f._jdf.queryExecution().executedPlan().toString() for f in (responses, clips) for kind in ("LocalTableScan", "ExistingRDD"))
    assert sorted((r.clip_id, r.fold, r.n) for r in clips.collect()) == [("S_000001", 0, 2), ("S_000002", 5, 2), ("S_000003", 7, 0)]
    assert sorted((r.response_key, r.clip_id, r.language) for r in responses.collect()) == [(0, "S_000001", "en"), (1, "S_000001", "en"), (2, "S_000002", None), (3, "S_000002", None)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        builders.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"], "t")


def test_documents_of_other_kinds(spark):
    texts = ["null", "[1,2]", '"text"', "", None, '{"record_type":"sample","harmonisation":[],"perception":3,"missingness":"x"}']
    found = samples.sample_findings(spark.createDataFrame(list(enumerate(texts)), "row_key long, value string")).collect()
    assert sorted(r.row_key for r in found if r.rule == "JSON") == [0, 1, 2, 3, 4]
    rules = {r.rule for r in found if r.row_key == 5}
    assert {"R01", "R02", "R03", "R04", "R05", "R13", "R19", "R27", "R31_list", "R32_list", "R33", "R34_list"} <= rules and "JSON" not in rules
    assert samples.sample_findings(spark.createDataFrame([], "row_key long, value string")).count() == 0


def test_packages_without_faults_are_valid(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_key long, id string")
    resource = checks.Resource("t", rows, "row_key", [checks.Field("id", "string", pattern="[ab]")], "id")
    findings = checks.package_findings([resource])
    assert findings.count() == 0 and [tuple(r) for r in checks.roll_up("p", [resource], findings).collect()] == [("p", "t", 0, True)]
    assert checks.described(spark, "p", [resource]).collect()[0]["constraints"] == '{"pattern": "[ab]"}'
