"""Scans of survey files: texts of cells, lines of JSON, whole JSON documents, workbooks, and where files are.

Paths may be of any store that Spark reads. Cells are read as text and typed afterwards, so that a bad cell is null or a
finding, never a failed job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import texts
from earshot.operators.samples import is_list, is_object, members, part
from earshot.sources import splits

KINDS = {"string": texts.present, "number": lambda c: texts.number(texts.present(c)), "integer": lambda c: texts.whole_number(texts.present(c))}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_path(spark: SparkSession, folder: str, name: str, below: Sequence[str] = ("", "data", "datav2")) -> str:
    """The first of some places of a file that is there, else an error that lists them."""
    tried = ["/".join(filter(None, (folder.rstrip("/"), b, name))) for b in below]
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(tried)}")


def one_source(**options: str | None) -> tuple[str, str]:
    """The one option that is given; an error where none or several are."""
    given = [(k, v) for k, v in options.items() if v]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(options)} must be given")
    return given[0]


def csv_texts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a CSV file or folder as text, empty for empty cells; an empty table where nothing is there
    (S02). Each file has a header, in any order; tasks read parts of a file, though cells may hold line ends."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return splits.csv_columns(*splits.csv_scan(spark, path), list(columns))


def csv_typed(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A CSV with cells by kind (string, number, integer); cells that count as missing, or are not of it, null."""
    return csv_texts(spark, path, list(kinds)).select(*[KINDS[k](F.col(f"`{c}`")).alias(c) for c, k in kinds.items()])


def json_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, line (from 1, blank ones counted) and value of every line that is not blank, of a file or of the files of a
    folder whose names are of a kind (S07). Sorted by file and line they are in the order of a reader that takes files by name."""
    lines = splits.with_line_numbers(splits.lines_of(spark, path, None if path.endswith(".jsonl") else glob))
    return lines.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", F.regexp_replace("value", "\r$", "").alias("value")).filter(F.trim("value") != "")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """file and value of whole JSON files."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")


def summary_index(docs: DataFrame) -> DataFrame:
    """clip_id, summary (variant) of packed summaries docs(value): a list, an object with a list `summaries`, or an object
    by clip; of several for one clip the last. Entries that are no objects, or without a clip, are left out (S10)."""
    doc = F.try_parse_json("value")
    listed = F.when(is_list(part(doc, "summaries")), part(doc, "summaries")).when(is_list(doc), doc)
    by_list = docs.select(F.posexplode(F.try_variant_get(listed, "$", "array<variant>")).alias("pos", "summary")).filter(is_object(F.col("summary")))
    by_list = by_list.select("pos", F.try_variant_get("summary", "$.clip_id", "string").alias("clip_id"), "summary")
    by_key = docs.filter(is_object(doc) & ~is_list(part(doc, "summaries"))).select(F.posexplode(F.map_entries(members(doc))).alias("pos", "e")).select("pos", F.col("e.key").alias("clip_id"), F.col("e.value").alias("summary"))
    both = by_list.unionByName(by_key.filter(is_object(F.col("summary")))).filter(F.coalesce("clip_id", F.lit("")) != "")
    return both.groupBy("clip_id").agg(F.max_by("summary", "pos").alias("summary"))


@dataclass(frozen=True)
class ClassMap:
    """Names of classes that mean another one, and the classes of each group."""

    version: str
    taxonomy: str
    groups: dict[str, list[str]]
    aliases: dict[str, str]


def class_map(docs: DataFrame) -> ClassMap:
    """The class map of the one document of docs(value), a configuration of bounded size that plans take as literals.

    Missing members are empty; members of another kind, no document or several, or one that is no JSON object, are an error.
    """
    found = docs.select("value").limit(2).collect()
    if len(found) != 1:
        raise ValueError("no class map, or several")
    doc = json.loads(found[0]["value"])
    if not isinstance(doc, dict):
        raise ValueError("a class map must be an object")
    groups, aliases = doc.get("groups") or {}, doc.get("aliases") or {}
    if not isinstance(groups, dict) or not all(isinstance(g, list) and all(isinstance(c, str) for c in g) for g in groups.values()):
        raise ValueError("groups must hold lists of classes by name")
    if not isinstance(aliases, dict) or not all(isinstance(c, str) for c in aliases.values()):
        raise ValueError("aliases must hold classes by name")
    return ClassMap(str(doc.get("version", "")), str(doc.get("taxonomy", "")), groups, aliases)


#: Files of a clip's summary in the order in which they are asked for.
SUMMARY_FILES = (".summary.json", "_summary.json", ".json", ".summary.csv", "_summary.csv", ".csv")


def summary_files(files: DataFrame) -> DataFrame:
    """clip_id, file: of the files of each clip the one that is asked for first (S11). files(file)."""
    ranked = [F.when(F.col("file").endswith(end), F.struct(F.lit(i).alias("rank"), F.regexp_replace("file", re.escape(end) + "$", "").alias("clip_id"))) for i, end in enumerate(SUMMARY_FILES)]
    found = files.withColumn("r", F.coalesce(*ranked)).filter("r IS NOT NULL")
    return found.groupBy(F.col("r.clip_id").alias("clip_id")).agg(F.min_by("file", "r.rank").alias("file"))


def class_rows(rows: DataFrame) -> DataFrame:
    """clip_id, frame_id, class_name, ratio of summary tables rows(file_clip, clip_id, frame_id, class_name, ratio, pos):
    rows of other clips than their file's are left out, the last of equal class and frame stays, bad ratios count 0 (S12)."""
    own = rows.filter(F.coalesce("clip_id", F.lit("")).isin("") | (F.col("clip_id") == F.col("file_clip")))
    last = own.groupBy(F.col("file_clip").alias("clip_id"), "frame_id", "class_name").agg(F.max_by("ratio", "pos").alias("ratio"))
    return last.withColumn("ratio", texts.number_or(F.col("ratio")))


_COLUMN = re.compile("[A-Z]+")


def sheet_rows(content: bytes, sheet: str | None) -> Iterator[list[str]]:
    """Rows of a workbook's sheet (the first, if none is named) as texts, gaps filled with empty ones."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {e.attrib["Id"]: e.attrib["Target"] for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]
        chosen = next((e for e in sheets if sheet is None or e.attrib["name"] == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet}")
        target = targets[next(v for k, v in chosen.attrib.items() if k.endswith("}id"))].lstrip("/")
        for row in (e for e in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if tag(e) == "row"):
            cells: list[str] = []
            for c in row:
                at = 0
                for letter in _COLUMN.match(c.attrib["r"])[0]:
                    at = at * 26 + ord(letter) - 64
                value = next((v.text or "" for v in c if tag(v) == "v"), "")
                kind = c.attrib.get("t")
                cells += [""] * (at - 1 - len(cells))
                cells.append(shared[int(value)] if kind == "s" else text(c) if kind == "inlineStr" else {"0": "False", "1": "True"}.get(value, value) if kind == "b" else value)
            yield cells


def workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, row (from 0), cells of the workbooks at a path, each read in one task (S05); unreadable ones give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = list(sheet_rows(content, sheet))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, row long, cells array<string>")


def with_header(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows(file, row, cells) below their header as columns; short rows are filled with empty texts."""
    return rows.filter("row > 0").select("file", "row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def asset_paths(clips: DataFrame, files: DataFrame, folders: Sequence[str], endings: Sequence[str]) -> DataFrame:
    """clip_id, path: for clips(clip_id, asset, asset_id) the first candidate that is among files(path): the asset, then its
    id, in each folder, and with each ending where the name has none; absolute paths as they are (S18)."""
    def options(name: str) -> F.Column:
        raw = F.trim(F.coalesce(name, F.lit("")))
        plain = [F.concat(F.lit(f"{d}/" if d else ""), raw) for d in folders]
        ended = [F.concat(p, F.lit(e)) for p in plain for e in endings]
        bare = ~F.element_at(F.split(raw, "/"), -1).contains(".")
        return F.when(raw == "", F.array().cast("array<string>")).when(raw.startswith("/"), F.array(raw)).when(bare, F.array(*plain, *ended)).otherwise(F.array(*plain))

    tried = clips.select("clip_id", F.posexplode(F.concat(options("asset"), options("asset_id"))).alias("rank", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("clip_id").agg(F.min_by("path", "rank").alias("path"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write the columns in order, those that are missing as empty cells, in place of what was there."""
    chosen = [F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*chosen).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
