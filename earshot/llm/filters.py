"""How filters of documents interact, read off a sparse matrix of documents and words.

Documents are gathered into shards of bounded text. A shard counts its words under numbers of its own; the distinct words
of all shards are numbered once for all, and each shard's columns take these numbers: a CSR matrix in pieces. Row sums
are documents' words, stored entries of a row its distinct words. Flags of the other filters travel with the rows, and
what is left of a document is a set of at most 2^n failed filters: counts of such sets answer for every order of filters.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import saved, small_batches

#: Text of a shard (one document more may pass it) and of a stretch that is split into words at once.
SHARD_BYTES, STRETCH = 4 << 20, 1 << 20
#: Words, counted once a shard, that a bucket numbers.
BUCKET_WORDS = 1_000_000
#: Shards that are looked through for words which many hold, in how many of them a word must be, and how many words at most.
SAMPLED, HOT_SHARDS, HOT_WORDS = 32, 8, 50_000

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
# The signs that filter D looks for.
SIGNS = b"#$%&*|"
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")

DOC = "struct<doc_id: long, part: string, flags: int, hash: binary>"
LOCAL = f"shard long, docs array<{DOC}>, n_words long, words binary, cells binary"
CHUNK = "b long, shard long, words binary, at binary, terms binary"
TOLD = "b long, shard long, at binary, terms binary, words binary, n long"
CSR = f"shard long, docs array<{DOC}>, indptr array<int>, terms array<long>, counts array<int>"
ROWS = "doc_id long, part string, flags int, hash binary, n_words long, n_distinct long"
_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("flags", pa.int32()), ("hash", pa.binary())]))
#: Rows of TOLD that hold a bucket's words instead of an answer, and the bucket of words that need none.
DICTIONARY, HOT = -1, -1


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<i4").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<i4")


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def sign_flags(raw: bytes) -> int:
    """The filters C and D that a text fails, from its UTF-8 bytes."""
    x = np.frombuffer(raw, np.uint8)
    upper, points = np.count_nonzero(x - np.uint8(65) < 26), np.count_nonzero(x & 0xC0 != 0x80)
    return C * (100 * upper > 2 * points) + D * any(sign in raw for sign in SIGNS)


def stretches(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about STRETCH bytes, cut at separators."""
    at = 0
    while at < len(raw):
        cut = _SEPARATOR.search(raw, at + STRETCH)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


class Numbers(dict):
    """Words under numbers in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Documents, their rows of a matrix, and its columns: words under the shard's own numbers."""

    def __init__(self):
        self.docs, self.known, self.size, self.indices, self.counts, self.lengths = [], Numbers(), 0, [], [], []

    def add(self, doc_id, part: str, raw: bytes) -> None:
        self.docs.append((doc_id, part, sign_flags(raw), hashlib.sha256(raw).digest()))
        self.size += len(raw)
        # words of bytes: split() cuts them at the six separators alone
        codes = [np.fromiter(map(self.known.__getitem__, stretch.split()), np.int32) for stretch in stretches(raw)]
        indices, counts = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int32), return_counts=True)
        self.indices.append(indices)
        self.counts.append(counts.astype(np.int32))
        self.lengths.append(len(indices))

    def batch(self, shard: int) -> pa.RecordBatch:
        """The shard as a row of LOCAL: words joined by spaces in the order of their hashes, cells as indptr, indices, counts."""
        words = list(self.known)
        order = np.argsort(hashes(words), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cells = packed(np.concatenate([np.cumsum([0, *self.lengths]), place[np.concatenate(self.indices)], *self.counts]))
        docs = pa.array([[dict(zip(("doc_id", "part", "flags", "hash"), d)) for d in self.docs]], _DOC)
        joined = zstandard.compress(b" ".join([words[i] for i in order.tolist()]), 1)
        return pa.RecordBatch.from_arrays([pa.array([shard]), docs, pa.array([len(words)]), pa.array([joined], pa.binary()), pa.array([cells], pa.binary())], names=["shard", "docs", "n_words", "words", "cells"])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def words_of(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split()


def shards_of(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """LOCAL rows of docs(doc_id, part, text)."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for doc_id, part, raw in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), pc.cast(batch.column("text"), pa.binary()).to_pylist()):
                shard.add(doc_id, part, raw)
                if shard.size >= shard_bytes:
                    yield shard.batch(number)
                    number, shard = number + 1, Shard()
        if shard.docs:
            yield shard.batch(number)

    return docs.mapInArrow(run, LOCAL)


def hot_limit(places: int, hot_words: int = HOT_WORDS, hot_shards: int = HOT_SHARDS) -> int:
    """In how many shards a word is hot: of `places` (shard, word) pairs, no more than hot_words words can be in more."""
    return max(hot_shards, places // hot_words)


def hot_words_of(shards: DataFrame, hot_words: int, hot_shards: int) -> dict[bytes, int]:
    """The words that many of a few shards hold, numbered from 0: at most hot_words."""
    some = [r["shard"] for r in shards.select("shard").orderBy(F.xxhash64("shard")).limit(SAMPLED).collect()]
    seen = shards.filter(F.col("shard").isin(some))
    limit = hot_limit(seen.agg(F.sum("n_words")).first()[0] or 0, hot_words, hot_shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(words_of(raw), pa.binary())], names=["word"])

    found = seen.select("words").mapInArrow(run, "word binary").groupBy("word").count().filter(F.col("count") > limit).select("word").collect()
    return {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in found))}


def chunks_of(shards: DataFrame, hot: dict[bytes, int], buckets: int) -> DataFrame:
    """CHUNK: each shard's words by bucket, a stretch of the hashes; those in hot with their numbers instead, in HOT."""
    shared = shards.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                words = words_of(raw)
                term = np.array([get(w, -1) for w in words], np.int64)
                at = np.flatnonzero(term < 0)
                cold = [words[i] for i in at.tolist()]
                bucket = hashes(cold) * buckets >> 32
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
                known = np.flatnonzero(term >= 0)
                rows = [(HOT, shard, None, packed(known), packed(term[known]))] if len(known) else []
                rows += [(int(bucket[a]), shard, zstandard.compress(b" ".join(cold[a:b]), 1), packed(np.diff(at[a:b], prepend=0)), None) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield from table_of(rows, CHUNK).to_batches()

    return shards.select("shard", "words").mapInArrow(run, CHUNK)


def numbered(chunks: DataFrame) -> DataFrame:
    """TOLD: the numbers that a bucket gives to the words of each of its chunks, and a row with its distinct words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words = [words_of(raw) for raw in rows.column("words").to_pylist()]
        found = pa.chunked_array([pa.array(w, pa.binary()) for w in words]).combine_chunks().dictionary_encode()
        terms = np.split(found.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])
        b = key[0].as_py()
        out = [(b, shard, at, packed(t), None, None) for shard, at, t in zip(rows.column("shard").to_pylist(), rows.column("at").to_pylist(), terms)]
        listed = zstandard.compress(b" ".join(found.dictionary.to_pylist()), 1)
        seen = packed(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)))
        return table_of([*out, (b, DICTIONARY, None, seen, listed, len(found.dictionary))], TOLD)

    return chunks.filter(F.col("b") != HOT).groupBy("b").applyInArrow(run, TOLD)


def assembled(docs: DataFrame, make, schema: str, shard_bytes: int = SHARD_BYTES, bucket_words: int = BUCKET_WORDS, hot_words: int = HOT_WORDS, hot_shards: int = HOT_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(dictionary, what make(shard, docs, indptr, terms, counts) returns for every shard) of docs(doc_id, part, text); see
    term_matrix()."""
    shards = saved(shards_of(docs, shard_bytes))
    hot = hot_words_of(shards, hot_words, hot_shards)
    buckets = (shards.agg(F.sum("n_words")).first()[0] or 0) // bucket_words + 1
    chunks = saved(chunks_of(shards, hot, buckets))
    told = saved(numbered(chunks))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    listed = told.filter(F.col("shard") == DICTIONARY).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + len(hot))
    known = chunks.filter(F.col("b") == HOT).select("shard", F.lit(None).cast("long").alias("start"), "at", "terms")
    answers = told.filter(F.col("shard") != DICTIONARY).join(listed.select("b", "start"), "b").select("shard", "start", "at", "terms").unionByName(known)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.zeros(left.column("n_words")[0].as_py(), np.int64)
        for start, at, terms in zip(*(right.column(c).to_pylist() for c in ("start", "at", "terms"))):
            own[unpacked(at) if start is None else np.cumsum(unpacked(at))] = unpacked(terms) + np.int64(start or 0)
        cells, n = unpacked(left.column("cells")[0].as_py()), len(left.column("docs")[0]) + 1
        indptr, (indices, counts) = cells[:n], np.split(cells[n:], 2)
        return make(left.column("shard"), left.column("docs"), indptr, own[indices], counts)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw, seen in zip(*(batch.column(c).to_pylist() for c in ("start", "words", "terms"))):
                words, n = words_of(raw), unpacked(seen).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(start + np.arange(len(words))), pa.array(n)], names=["word", "term", "shards"])

    common = chunks.filter(F.col("b") == HOT).select("terms").mapInArrow(_each_number, "term long").groupBy("term").agg(F.count("*").alias("shards"))
    names = docs.sparkSession.createDataFrame([(w.decode(), i) for w, i in hot.items()], "word string, term long")
    dictionary = listed.select("start", "words", "terms").mapInArrow(entries, "word string, term long, shards long").unionByName(common.join(names, "term").select("word", "term", "shards"))
    return dictionary, shards.drop("words").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema)


def _each_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("terms").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(raw).astype(np.int64))], names=["term"])


def term_matrix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(dictionary(word, term, shards), CSR shards) of docs(doc_id, part, text).

    Row i of a shard holds the entries indptr[i] to indptr[i + 1] of terms and counts; terms are numbers from 0 without
    gaps. Words that very many shards hold are found in a sample of shards and numbered by a broadcast of bounded size. All
    others are sent, once a shard, to buckets by hash, which number and answer; numbers of buckets follow one another.
    """

    def make(shard, docs, indptr, terms, counts) -> pa.Table:
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table([shard, docs, one(indptr, pa.int32()), one(terms, pa.int64()), one(counts, pa.int32())], names=["shard", "docs", "indptr", "terms", "counts"])

    return assembled(docs, make, CSR, **options)


def row_sums(docs: DataFrame, **options) -> DataFrame:
    """ROWS of docs(doc_id, part, text): of each document's row of the matrix the sum of counts and the number of entries."""

    def make(shard, docs, indptr, terms, counts) -> pa.Table:
        upto = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        numbers = (np.diff(upto[indptr]), np.diff(indptr).astype(np.int64))
        return pa.table([*docs.combine_chunks().values.flatten(), *map(pa.array, numbers)], names=["doc_id", "part", "flags", "hash", "n_words", "n_distinct"])

    return assembled(docs, make, ROWS, **options)[1]


def failures(docs: DataFrame, **options) -> DataFrame:
    """doc_id, part, n_words, n_distinct and failed (bits A to E) of each row of docs(doc_id, text, source).

    A null text counts as empty, a null source is the part of the empty one. A row fails E where a smaller doc_id has its
    text (by SHA-256); null ids are neither smaller nor larger than any, and rows of one id do not fail by each other.
    The smallest id of each text is found by partial minima and joined by text and id, so that many copies of one text
    stay spread.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = saved(row_sums(plain, **options))
    short, dull = F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.filter("doc_id IS NOT NULL").join(firsts, ["hash", "doc_id"], "left").withColumn("copy", F.col("first").isNull()).drop("first")
    both = named.unionByName(rows.filter("doc_id IS NULL").withColumn("copy", F.lit(False)))
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    return both.select("doc_id", "part", "n_words", "n_distinct", (F.col("flags") + bit(short, A) + bit(dull, B) + bit(F.col("copy"), E)).alias("failed"))


def steps() -> list[dict]:
    """Each filter's place in each order: its bit, and the bits of those before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for each part,
    order of the five filters and step.

    labels(doc_id, quality, toxic): of several rows of one id any that says 1 counts; documents without a label are
    neither good nor toxic, as those with a null id. An empty table gives no rows. Other columns are ignored. Documents
    are counted by part and set of failed filters, at most 32 numbers a part, from which all steps are read.
    """
    failed = failures(docs, **options)
    says = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    named = failed.filter("doc_id IS NOT NULL").join(says, "doc_id", "left").select("part", "failed", "good", "toxic")
    nameless = failed.filter("doc_id IS NULL").select("part", "failed", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    counts = named.unionByName(nameless).groupBy("part", "failed").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    sets = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("failed", F.struct("n", "good", "toxic")))).alias("of"))  # 32 at most
    full = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    each = F.transform(full, lambda i: F.col("of")[i])
    arrays = sets.select("part", each.alias("each")).select("part", *[F.transform(F.col("each")[c], lambda x: F.coalesce(x, F.lit(0))).alias(c) for c in ("n", "good", "toxic")])
    listed = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    at = arrays.withColumn("s", F.explode(listed)).select("part", "s.*", "n", "good", "toxic")

    def total(column: str, cond: str, times: str = "1") -> str:
        return f"aggregate(sequence(0, 31), 0L, (t, i) -> t + CASE WHEN {cond} THEN {column}[i] * {times} ELSE 0L END)"

    here = "i & before = 0 AND i & bit > 0"
    return at.selectExpr("part", "filter_order", "step", f"{total('n', 'i & (before | bit) = 0')} AS kept", f"{total('n', here)} AS removed", f"{total('n', 'i & before > 0 AND i & bit > 0')} AS redundant",
                         "n[bit] AS unique_fails", f"{total('good', here)} AS good_lost", f"{total('toxic', here)} AS toxic_lost",
                         # of a set of k failed filters, each comes first in 120 / k orders
                         f"{total('n', 'i & bit > 0', 'cast(120 div greatest(bit_count(i), 1) AS bigint)')} AS shapley")
