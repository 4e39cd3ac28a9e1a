"""Large JSON documents of many entries, read by ranges: no task holds a document, only entries.

A packed document is a list of objects, an object with a list `summaries`, or an object of objects by key. Files are cut at
closing braces, in ranges that Spark deals to tasks. A range can't know whether it starts in a string, nor how deep: a first
pass finds for both cases what the range closes and leaves open; chained along a file, this gives every range its start.
A second pass cuts out entries; those that cross a border come as fragments and are put together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.sources.splits import HEAD, MIDDLE, TAIL, WHOLE, ranges_in

LISTED = "summaries"
_BODY = re.compile(r'(?:[^"\\]|\\.)*+', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("|\Z)|[{}\[\]]', re.S)
#: A row of a list of entries, beside the kinds of fragments.
MARK = 9

EFFECT = "file string, start long, " + ", ".join(f"ends{i} boolean, closes{i} long, opens{i} string" for i in (0, 1))
STARTS = "file string, start long, inside boolean, stack string"
PIECE = "file string, start long, seq long, kind int, form string, key string, text string"
_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("form", pa.string()), ("key", pa.string()), ("text", pa.string())])


def scan(text: str, inside: bool, on: Callable[[str, int, str | None], None]) -> bool:
    """Call on(bracket, place, key) for the brackets of a text that starts in a string or not; whether it ends in one. An
    opening list of summaries is S; key is the string before an opening one, if a colon alone is between."""
    at = 0
    if inside:
        at = _BODY.match(text).end() + 1
        if at > len(text):
            return True
    last = None
    for m in _TOKEN.finditer(text, at):
        ch = text[m.start()]
        if ch == '"':
            if not m.group(1):
                return True
            last = m.span()
        elif ch in "}]":
            on(ch, m.start(), None)
        else:
            key = text[last[0] : last[1]] if last and text[last[1] : m.start()].strip() == ":" else None
            on("S" if ch == "[" and key == f'"{LISTED}"' else ch, m.start(), key)
    return False


def segments_of(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, start (of the range), alone (whether the range is the whole file) and value: texts up to and with the next closing
    brace, in order within a range."""
    reader = spark.read.option("lineSep", "}")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.expr("_metadata.file_block_length = _metadata.file_size").alias("alone"), F.concat("value", F.lit("}")).alias("value"))


def keyed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """(file and start, whether they are new, part) of batches in stretches of one range."""
    key = None
    for batch in batches:
        for part in ranges_in(batch):
            here = part.column("file")[0].as_py(), part.column("start")[0].as_py()
            yield here, here != key, part
            key = here


def effects(segments: DataFrame) -> DataFrame:
    """EFFECT: for a start out of a string and in one, whether the range ends in one, how many brackets it closes that it has
    not opened, and which it leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, at = [f.split()[0] for f in EFFECT.split(", ")], [], None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *(v for ends, closes, opens in state for v in (ends, closes[0], "".join(opens))))], names=names)

        for key, new, part in keyed_parts(batches):
            if new:
                if at:
                    yield row()
                at, state = key, [[False, [0], []], [True, [0], []]]
            for text in part.column("value").to_pylist():
                for s in state:
                    closes, opens = s[1], s[2]

                    def on(ch: str, _, __) -> None:
                        if ch not in "}]":
                            opens.append(ch)
                        elif opens:
                            opens.pop()
                        else:
                            closes[0] += 1

                    s[0] = scan(text, s[0], on)
        if at:
            yield row()

    return segments.mapInArrow(run, EFFECT)


def chained(effect: DataFrame) -> DataFrame:
    """STARTS: how each range of a file starts; a row for each range, a file's in one task."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        inside, stack, out = False, "", []
        for r in rows.sort_by("start").to_pylist():
            out.append((r["file"], r["start"], inside, stack))
            i = int(inside)
            inside, stack = r[f"ends{i}"], stack[: max(0, len(stack) - r[f"closes{i}"])] + r[f"opens{i}"]
        return pa.table([pa.array(c) for c in zip(*out)], names=["file", "start", "inside", "stack"])

    return effect.groupBy("file").applyInArrow(run, STARTS)


class Reader:
    """Cuts the entries out of a range, segment by segment."""

    def __init__(self, key: tuple[str, int], inside: bool, stack: str):
        self.key, self.inside, self.stack, self.seq = key, inside, list(stack), 0
        self.base = next((len(b) for b in ("[", "{S", "{") if stack.startswith(b + "{")), None)  # within an entry
        self.begun, self.held, self.form, self.name, self.rows = self.base is None, [], None, None, []

    def add(self, kind: int, text: str) -> None:
        self.seq += 1
        self.rows.append((*self.key, self.seq, kind, self.form, self.name, text))

    def feed(self, text: str) -> None:
        from_ = 0

        def on(ch: str, at: int, key: str | None) -> None:
            nonlocal from_
            stack = self.stack
            if ch not in "}]":
                here = "".join(stack[:3])
                if self.base is None and ch == "{" and here in ("[", "{S", "{"):
                    self.base, self.begun, from_, self.held = len(stack), True, at, []
                    self.form, self.name = ("M", json.loads(key or '""')) if here == "{" else ("L", None)
                elif ch == "S" and here == "{":
                    self.form, self.name = None, None
                    self.add(MARK, "")
                stack.append(ch)
            elif stack:
                stack.pop()
                if self.base is not None and len(stack) == self.base:
                    self.add(WHOLE if self.begun else HEAD, "".join(self.held) + text[from_ : at + 1])
                    self.base, self.held = None, []

        self.inside = scan(text, self.inside, on)
        if self.base is not None:
            self.held.append(text[from_:])

    def end(self) -> None:
        if self.base is not None:
            self.add(TAIL if self.begun else MIDDLE, "".join(self.held))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, r)) for r in rows], _PIECE)


def packed_entries(spark: SparkSession, path: str, glob: str | None = "*.json") -> DataFrame:
    """file, start, seq, key and text of every entry of the packed documents at a path; (file, start, seq) is their order.

    key is null for entries of lists. Entries that are no objects are left out, as are members beside a list of summaries.
    Documents are not checked as a whole: of a broken one, entries count that can be cut out. Files must not change
    meanwhile: those of several ranges are read twice. A file of one range starts as any file does and needs no first pass.
    """
    segments = segments_of(spark, path, glob)
    starts = chained(effects(segments.filter("NOT alone"))).cache()
    placed = segments.join(F.broadcast(starts), ["file", "start"], "left")  # a row for each range of files of several
    placed = placed.withColumns({"inside": F.coalesce("inside", F.lit(False)), "stack": F.coalesce("stack", F.lit(""))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for key, new, part in keyed_parts(batches):
            if new:
                if reader:
                    reader.end()
                    yield reader.taken()
                reader = Reader(key, part.column("inside")[0].as_py(), part.column("stack")[0].as_py())
            for text in part.column("value").to_pylist():
                reader.feed(text)
            yield reader.taken()
        if reader:
            reader.end()
            yield reader.taken()

    pieces = placed.mapInArrow(run, PIECE)
    whole = pieces.filter(F.col("kind") == WHOLE).drop("kind")
    order = Window.partitionBy("file").orderBy("start", "seq")  # fragments: two a range at most
    told = pieces.filter(F.col("kind").isin(TAIL, MIDDLE, HEAD)).withColumn("entry", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x["text"]), "")
    first = F.min_by(F.struct("start", "seq", "form", "key"), F.struct("start", "seq"))
    joined = told.groupBy("file", "entry").agg(first.alias("f"), texts.alias("text")).select("file", "f.*", "text")
    lists = pieces.filter(F.col("kind") == MARK).select("file").distinct()
    entries = whole.unionByName(joined)
    members = entries.filter("form = 'M'").join(lists, "file", "left_anti")
    return entries.filter("form = 'L'").unionByName(members).select("file", "start", "seq", "key", "text")


def packed_index(spark: SparkSession, path: str, glob: str | None = "*.json") -> DataFrame:
    """clip_id, summary (variant) of the entries of packed documents: of several for one clip the last of the last file by
    name. Entries without a clip, or that do not parse, are left out; partial maxima come before the shuffle."""
    rows = packed_entries(spark, path, glob).withColumn("summary", F.try_parse_json("text"))
    named = rows.withColumn("clip_id", F.coalesce("key", F.try_variant_get("summary", "$.clip_id", "string"))).filter("coalesce(clip_id, '') <> '' AND summary IS NOT NULL")
    return named.groupBy("clip_id").agg(F.max_by("summary", F.struct("file", "start", "seq")).alias("summary"))
