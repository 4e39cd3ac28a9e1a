"""Files that many tasks read in parts: against Python's csv module and plain line numbers, with very small ranges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from earshot.sources import readers, splits

random.seed(2)
CELLS = ["", "a", "é漢", 'say "hi"', "x,y", "two\nlines", "\n", 'end"', "\r\n", '"', '""', "\n\n,\n\"q\"\n", "long " * 30, " b "]


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before, opened = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", opened)


def written(rows, path, end="\r\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=quoting).writerows(rows)


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return [r for r in csv.reader(f) if r]


def test_ranges_give_the_records_of_a_whole_reader(spark, tmp_path, small_ranges):
    for i in range(6):
        rows = [["id", "name", "note"]] + [[f"{i}_{k}", random.choice(CELLS), random.choice(CELLS)] for k in range(60)]
        written(rows, tmp_path / f"{i}.csv", random.choice(["\n", "\r\n"]), random.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    assert splits.lines_of(spark, str(tmp_path)).select("file", "start").distinct().count() > 60  # many ranges
    got = splits.csv_records(spark, str(tmp_path)).orderBy("file", "line").collect()
    want = [r for i in range(6) for r in read(tmp_path / f"{i}.csv")]
    assert [r.cells for r in got] == want
    table = readers.csv_texts(spark, str(tmp_path), ["note", "id", "gone"]).collect()
    assert sorted(map(tuple, table)) == sorted((r[2], r[0], "") for r in want if r[0] != "id")


def test_one_cell_over_many_ranges_and_odd_quotes(spark, tmp_path, small_ranges):
    text = 'id,note\r\n1,"' + "line\n" * 200 + '"\r\n2,5" pipe, "no quote"\r\n\r\n3,"closed"tail"x",y\r\n4,"never closed\nmore'
    (tmp_path / "a.csv").write_bytes(text.encode())
    got = splits.csv_records(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.cells for r in got] == [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    assert [r.line for r in got] == [1, 2, 203, 205, 206]


def test_starts_follow_from_all_before(spark):
    """Random chains of ranges against running through them one after another."""
    kinds = [(False, True), (True, False), (False, False), (True, True)]
    rows, want = [], {}
    for f in range(40):
        state = False
        for k in range(30):
            ends = random.choice(kinds[:2] if f % 2 else kinds)
            rows.append((f"f{f}", k * 64, 3, *ends))
            want[f"f{f}", k * 64] = (3 * k, state)
            state = ends[state]
    starts = splits.range_starts(spark.createDataFrame(rows, "file string, start long, n long, outside boolean, inside boolean"))
    assert {(r.file, r.start): (r.before, r.within) for r in starts.collect()} == want


def test_columns_follow_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2\n")
    (tmp_path / "b.csv").write_text("name,more,id,name\nfirst,m,3,last\n,,,,\n")
    got = sorted(map(tuple, readers.csv_texts(spark, str(tmp_path), ["id", "name"]).collect()))
    assert got == [("", ""), ("1", "x"), ("2", ""), ("3", "last")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text('\n\r\n"i\n' + "x" * 200 + '\nd",name\n5,y\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert [tuple(r) for r in readers.csv_texts(spark, str(tmp_path / "c"), ["i\n" + "x" * 200 + "\nd", "name"]).collect()] == [("5", "y")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty").mkdir()
    assert readers.csv_texts(spark, str(tmp_path / "empty"), ["id"]).collect() == []


def test_line_numbers_over_ranges(spark, tmp_path, small_ranges):
    for name, n in (("a", 300), ("b", 7)):
        (tmp_path / f"{name}.jsonl").write_text("".join("\n" if k % 5 == 0 else f'{{"k":{k}}}\n' for k in range(1, n)))
    got = readers.json_lines(spark, str(tmp_path)).select("file", "line", F.get_json_object("value", "$.k").cast("long").alias("k")).collect()
    assert len(got) == sum(k % 5 != 0 for n in (300, 7) for k in range(1, n)) and all(r.line == r.k for r in got)
