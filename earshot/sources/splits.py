"""Lines and quoted CSV records of files that many tasks read in parts.

Spark deals byte ranges of a file to tasks; a line belongs to the range that it starts in. Lines in a range come in order,
so that counts of ranges give every line its number. A quoted cell may hold line ends: whether a range starts inside one
depends on all before it, but there are only two cases. A first pass finds, for both, in which case each range ends;
chained along a file, this fixes every start. A second pass cuts each range into records, and what crosses a border comes
as fragments, two a range at most, which are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of all files together whose starts are broadcast: a petabyte of Spark's default ranges.
MOST_RANGES = 8_000_000


def lines_of(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, start (of the range), at (increasing within it) and value of every line, cut at line feeds alone."""
    reader = spark.read.option("lineSep", "\n")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """lines with line, from 1 in each file. Files must stay as they are: they are read twice, first to count."""
    ranges = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    placed = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "start", "first", "before")
    return lines.join(placed, ["file", "start"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("first", "before")


class Cutter:
    """Where quoted cells begin and end: a quote opens one only at a cell's start; in it, two quotes are one."""

    def __init__(self, delimiter: str = ","):
        d, self.delimiter = re.escape(delimiter), delimiter
        inside = r'(?:[^"]|"")*+'
        self.opened = re.compile(rf'(?:(?:"{inside}"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+"{inside}\Z')
        self.body = re.compile(inside)
        self.cell = re.compile(rf'(?:"({inside})(?:"([^{d}]*+)|\Z)|([^{d}]*+))({d}|\Z)')

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether a line that starts inside a quoted cell, or not, leaves the next one inside."""
        if inside:
            end = self.body.match(line).end()
            if end == len(line):
                return True
            line = line[end + 1 :].partition(self.delimiter)[2]
        return self.opened.match(line) is not None

    def cells(self, record: str) -> list[str]:
        out, at = [], 0
        while True:
            m = self.cell.match(record, at)
            quoted, rest, plain, border = m.groups()
            out.append(plain if quoted is None else quoted.replace('""', '"') + (rest or ""))
            if not border:
                return out
            at = m.end()


def ranges_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of one file and range."""
    if len(batch):
        start, file = batch.column("start").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            yield batch.slice(a, b - a)


ENDS = "file string, start long, n long, outside boolean, inside boolean, head string, top long"


def range_ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """ENDS: lines of each range, whether it ends inside a quoted cell if it starts outside or inside; of a file's first
    range also the first record and its line, where it ends in that range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, key, ends, n, top = Cutter(delimiter), None, [False, True], 0, 0
        head: list[str] | None = None  # lines of the first record so far
        done = None

        def row() -> pa.RecordBatch:
            columns = [pa.array([x]) for x in (*key, n, *ends)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([done], pa.string()), pa.array([top])], names=["file", "start", "n", "outside", "inside", "head", "top"])

        for batch in batches:
            for part in ranges_in(batch):
                here = part.column("file")[0].as_py(), part.column("start")[0].as_py()
                if here != key:
                    if key:
                        yield row()
                    key, ends, n, top, head, done, inside = here, [False, True], 0, 0, [] if here[1] == 0 else None, None, False
                value, at = part.column("value"), n
                n += len(part)
                while head is not None and at < n:
                    line, at = value[len(part) - (n - at)].as_py(), at + 1
                    inside = cutter.ends_inside(line, inside)
                    if head or line not in ("", "\r"):
                        top = top or at
                        head.append(line)
                        if not inside:
                            head, done = None, "\n".join(head).removesuffix("\r")
                # lines without quotes change nothing
                for line in value.filter(pc.match_substring(value, '"')).to_pylist():
                    ends = [cutter.ends_inside(line, e) for e in ends]
        if key:
            yield row()

    return lines.select("file", "start", "value").mapInArrow(run, ENDS)


def range_starts(ends: DataFrame) -> DataFrame:
    """file, start, before (lines) and within (whether it starts inside a quoted cell) of each range: the last range before
    it that ends alike in both cases says how it starts, if those between turn it over, by their number."""
    order = Window.partitionBy("file").orderBy("start")
    known = F.when(F.col("outside") == F.col("inside"), F.col("outside"))
    turns = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    marked = ends.select("file", "start", "n", known.alias("known"), turns.alias("turns"), F.sum(turns).over(order).alias("turned"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("known").isNotNull(), F.struct("known", "turned")), ignorenulls=True).over(before)
    placed = marked.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), last.alias("last"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("upto"))
    odd = (F.col("upto") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return placed.select("file", "start", "before", (F.coalesce(F.col("last.known"), F.lit(False)) != odd).alias("within"))


PIECE = "file string, start long, line long, kind int, value string, cells array<string>"
WHOLE, TAIL, MIDDLE, HEAD = range(4)


def pieces_of(lines: DataFrame, starts: DataFrame, delimiter: str) -> DataFrame:
    """PIECE: records with their cells, and the text of fragments of records that cross a border."""
    kind = pa.schema([("file", pa.string()), ("start", pa.int64()), ("line", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, key, number, inside, held, first, kept = Cutter(delimiter), None, 0, False, [], 0, []

        def left() -> list[tuple]:
            """What is open at the end of a range."""
            return [(*key, first, MIDDLE if kept else TAIL, "\n".join(held), None)] if held else []

        for batch in batches:
            for part in ranges_in(batch):
                here, rows = (part.column("file")[0].as_py(), part.column("start")[0].as_py()), []
                if here != key:
                    rows += left() if key else []
                    key, number, inside, held = here, part.column("before")[0].as_py(), part.column("within")[0].as_py(), []
                    first, kept = number + 1, inside  # kept: the record began in an earlier range
                value = part.column("value")
                if not inside and not pc.any(pc.match_substring(value, '"')).as_py():
                    plain = pc.replace_substring_regex(value, "\r$", "")
                    n = len(part)
                    columns = [part.column("file"), part.column("start"), pa.array(np.arange(number + 1, number + n + 1)), pa.array(np.full(n, WHOLE, np.int32)), pa.nulls(n, pa.string()), pc.split_pattern(plain, delimiter)]
                    number += n
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
                    yield pa.RecordBatch.from_arrays(columns, schema=kind).filter(pc.not_equal(plain, ""))
                    continue
                for line in value.to_pylist():
                    number += 1
                    if not held:
                        first = number
                    held.append(line)
                    inside = cutter.ends_inside(line, inside) if '"' in line else inside
                    if not inside:
                        text, held = "\n".join(held), []
                        if kept:
                            rows.append((*key, first, HEAD, text, None))
                        elif text not in ("", "\r"):
                            rows.append((*key, first, WHOLE, None, cutter.cells(text.removesuffix("\r"))))
                        kept = False
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in left()], kind)

    return lines.select("file", "start", "value").join(F.broadcast(starts), ["file", "start"]).mapInArrow(run, PIECE)


def csv_scan(spark: SparkSession, path: str, delimiter: str = ",", glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records(file, line, cells), headers(file, top, header)) of the CSV files at a path; see csv_records()."""
    lines = lines_of(spark, path, glob)
    ends = range_ends(lines, delimiter).cache()
    if ends.count() > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges: set spark.sql.files.maxPartitionBytes higher")
    pieces = pieces_of(lines, range_starts(ends), delimiter)
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "line", "cells")
    order = Window.partitionBy("file").orderBy("start", "line", F.col("kind").desc())  # fragments: two a range at most
    told = pieces.filter(F.col("kind") != WHOLE).withColumn("record", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    joined = told.groupBy("file", "record").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "value"))), lambda x: x["value"]), "\n").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(delimiter)
        for batch in batches:
            cells = [cutter.cells(v.removesuffix("\r")) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line"), pa.array(cells, pa.list_(pa.string()))], names=["file", "line", "cells"])

    def parsed(rows: DataFrame) -> DataFrame:
        return rows.select("file", "line", "value").mapInArrow(run, "file string, line long, cells array<string>")

    records = whole.unionByName(parsed(joined))
    heads = parsed(ends.filter("head IS NOT NULL").select("file", F.col("top").alias("line"), F.col("head").alias("value")))
    late = ends.filter("start = 0 AND head IS NULL").select("file")  # a first record that ends in a later range
    if not late.isEmpty():
        first = records.join(late, "file", "left_semi").groupBy("file").agg(F.min("line").alias("line"), F.min_by("cells", "line").alias("cells"))
        heads = heads.unionByName(first)
    return records, heads.select("file", F.col("line").alias("top"), F.col("cells").alias("header"))


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", glob: str | None = None) -> DataFrame:
    """file, line (that a record starts in, from 1) and cells of every record of the CSV files at a path; blank lines are none.

    Files are read by ranges, twice. A cell that is never closed ends with its file. Files must not change meanwhile. A
    record is in the memory of one task, however many ranges it spans.
    """
    return csv_scan(spark, path, delimiter, glob)[0]


def csv_columns(records: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of records by the header of each file, its first record; a cell that is missing, as one of a column
    that the header lacks, is empty; of columns of one name the last decides."""
    where = [(F.size("header") - F.array_position(F.reverse("header"), c)).alias(f"_{i}") for i, c in enumerate(columns)]
    there = [F.array_contains("header", c).alias(f"_has{i}") for i, c in enumerate(columns)]
    rows = records.join(headers.select("file", "top", *where, *there), "file").filter(F.col("line") > F.col("top"))
    return rows.select(*[F.coalesce(F.when(F.col(f"_has{i}"), F.get("cells", F.col(f"_{i}").cast("int"))), F.lit("")).alias(c) for i, c in enumerate(columns)])
