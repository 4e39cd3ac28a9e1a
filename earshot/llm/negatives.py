"""Hard negatives by exact integer scores, multiplied in a residue number system.

Components become integers. Their residues modulo a few small primes are multiplied as float32 matrices, in which sums of
that size are exact; the residues of a score give the score by Chinese remaindering, as the primes' product is above twice
the largest score that the norms allow. Anchors are a stated set of queries against all rows: blocks of bounded bytes,
broadcast one at a time. Each task scores its rows against the block, keeps what a later row could not displace (the best
positives; then for each positive the best negatives in its window), and partial lists are merged by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import discard, saved, shared_dir, small_batches

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LEAST / WHOLE of its positive's, and no larger.
LEAST, WHOLE = 80, 100
SCALE = 256.0
#: Rows scored at once, anchors of a block and their bytes.
ROW_BLOCK, ANCHOR_BLOCK, ANCHOR_BYTES = 1_024, 2_048, 32 << 20
# The largest primes below 2^8. All of them hold any score of 62 bits.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
#: Sums of float32 products of residues up to half a prime are exact below 2^24: as many components at once.
DEPTH = (1 << 24) // (max(PRIMES) // 2) ** 2
LARGEST = 1 << 60

VECTORS = "uid long, vec_id long, label long, q binary, size int"
FOUND = "anchor long, slot int, score long, vec_id long, uid long"


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product is above twice the bound."""
    if bound > LARGEST:
        raise ValueError(f"scores up to {bound} do not fit a long")
    product, n = 1, 0
    while product <= 2 * bound:
        product, n = product * PRIMES[n], n + 1
    return PRIMES[: max(n, 1)]


def residues(q: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers in double precision modulo a prime, in -(p - 1) / 2 .. (p - 1) / 2, as float32."""
    r = np.fmod(q, prime)  # exact
    r -= prime * np.rint(r / prime)
    return r.astype(np.float32)


def balanced(x: np.ndarray, prime: int) -> np.ndarray:
    half = prime // 2
    return (x + half) % prime - half


def products(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left times the transpose of right modulo a prime, from residues."""
    total = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], DEPTH):
        part = left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T
        total = balanced(total + part.astype(np.int32), prime)
    return total


def remaindered(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The numbers of least size that have the given (balanced) residues, in mixed radix: each digit is what a prime's
    residue adds to the number that the primes before it give."""
    out, step = parts[0].astype(np.int64), primes[0]
    for part, prime in zip(parts[1:], primes[1:]):
        digit = balanced((part - out % prime) * pow(step, -1, prime), prime)
        out += digit * np.int64(step)
        step *= prime
    return out


@dataclass
class Block:
    """Anchors with their residues, labels, and for the second pass the windows of their positives."""

    uid: np.ndarray
    label: np.ndarray
    residues: list[np.ndarray]
    primes: tuple[int, ...]
    width: int
    high: np.ndarray | None = None  # (anchors, slots): scores of positives, and the least that their negatives may have
    low: np.ndarray | None = None

    def scores(self, q: np.ndarray) -> np.ndarray:
        return remaindered([products(residues(q, p), r, p) for p, r in zip(self.primes, self.residues)], self.primes)


def matrix_of(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of VECTORS as a matrix, shorter ones filled with zeros."""
    out = np.zeros((len(table), width))
    for i, raw in enumerate(table.column("q").to_pylist()):
        v = np.frombuffer(raw, "<f8")
        out[i, : len(v)] = v
    return out


class Best:
    """For each (anchor, slot) the entries that come first by score (descending), vec_id and uid: `most` of each."""

    def __init__(self, anchors: int, slots: int, most: int):
        self.slots, self.most = slots, most
        self.rows = np.zeros((0, 4), np.int64)  # key, score, vec_id, uid
        self.least = np.full((anchors, slots), np.iinfo(np.int64).min)  # of full lists, the score and vec_id of the last
        self.last = np.full((anchors, slots), np.iinfo(np.int64).max)

    def add(self, anchor: np.ndarray, slot: int, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        new = (score > self.least[anchor, slot]) | (vec_id <= self.last[anchor, slot])  # of many ties, few
        if new.any():
            columns = (anchor * self.slots + slot, score, vec_id, uid)
            self.rows = np.concatenate([self.rows, np.stack([c[new] for c in columns], axis=1)])

    def trim(self) -> None:
        order = np.lexsort((self.rows[:, 3], self.rows[:, 2], -self.rows[:, 1], self.rows[:, 0]))
        rows = self.rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(rows)])
        place = np.arange(len(rows)) - np.repeat(first, sizes)
        self.rows = rows[place < self.most]
        full = first[sizes >= self.most]
        self.least.ravel()[rows[full, 0]], self.last.ravel()[rows[full, 0]] = rows[full + self.most - 1, 1:3].T

    def batch(self, uids: np.ndarray) -> pa.RecordBatch:
        key = self.rows[:, 0]
        columns = [pa.array(uids[key // self.slots]), pa.array((key % self.slots).astype(np.int32)), *(pa.array(self.rows[:, i]) for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def keep_positives(block: Block, best: Best, s: np.ndarray, rows: pa.RecordBatch) -> None:
    uid, vec_id = rows.column("uid").to_numpy(), rows.column("vec_id").to_numpy()
    at, anchor = np.nonzero((rows.column("label").to_numpy()[:, None] == block.label) & (s >= best.least[:, 0]) & (uid[:, None] != block.uid))
    best.add(anchor, 0, s[at, anchor], vec_id[at], uid[at])


def keep_negatives(block: Block, best: Best, s: np.ndarray, rows: pa.RecordBatch) -> None:
    uid, vec_id = rows.column("uid").to_numpy(), rows.column("vec_id").to_numpy()
    least = np.maximum(block.low, best.least)
    at, anchor = np.nonzero((s <= block.high.max(axis=1)) & (s >= least.min(axis=1)) & (rows.column("label").to_numpy()[:, None] != block.label))
    score = s[at, anchor]
    for slot in range(block.high.shape[1]):
        fits = (score <= block.high[anchor, slot]) & (score >= least[anchor, slot])
        best.add(anchor[fits], slot, score[fits], vec_id[at[fits]], uid[at[fits]])


def scanned(rows: DataFrame, block: Block, keep, slots: int, most: int) -> DataFrame:
    """FOUND: the first `most` rows of each anchor and slot of a block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, None
        for batch in batches:
            best = best or Best(len(block.uid), slots, most)
            for at in range(0, len(batch), ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                keep(block, best, block.scores(matrix_of(part, block.width)), part)
                best.trim()
        if best is not None:
            yield best.batch(block.uid)

    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id", "uid")
    return rows.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def prepared(vectors: DataFrame) -> DataFrame:
    """VECTORS of the rows of vectors(vec_id, embedding, label) that take part, with components as whole numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).filter(finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            q = np.floor(lists.flatten().to_numpy() * SCALE)
            cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            raw = [q[a:b].astype("<f8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "vec_id", "label")), pa.array(raw, pa.binary()), lists.value_lengths()], names=["uid", "vec_id", "label", "q", "size"])

    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v").mapInArrow(run, VECTORS)


def largest_score(rows: DataFrame) -> tuple[int, int]:
    """(the largest size that a score can have, by the largest norm; the longest vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, width = 0.0, 0
        for batch in batches:
            for raw in batch.column("q").to_pylist():
                v = np.frombuffer(raw, "<f8")
                with np.errstate(over="ignore"):
                    norm, width = max(norm, float(v @ v)), max(width, len(v))
        yield pa.RecordBatch.from_arrays([pa.array([norm]), pa.array([width], pa.int32())], names=["norm", "width"])

    found = rows.select("q").mapInArrow(run, "norm double, width int").agg(F.max("norm"), F.max("width")).first()
    norm = found[0] or 0.0
    return (LARGEST + 1 if norm > LARGEST else int(norm * (1 + 1e-9)) + 1), found[1] or 0


def collected(anchors: DataFrame, width: int, primes: tuple[int, ...]) -> Block:
    table = anchors.toArrow().sort_by("uid")
    q = matrix_of(table, width)
    return Block(table.column("uid").to_numpy(), table.column("label").to_numpy(), [residues(q, p) for p in primes], primes, width)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. Rows with a null vec_id, label or vector, or a component that
    is null or not finite, take no part. Vectors of different lengths are filled up with zeros, an empty one scores 0 with
    all. Rows are their own even where they share a vec_id: each is an anchor by itself, and may be another one's positive;
    ties of score and vec_id give equal result rows. Anchors without a positive, or positives without a negative in
    their window, give no rows, as an empty table does. Scores beyond 60 bits are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4 * ROW_BLOCK)
    rows = saved(prepared(vectors))
    bound, width = largest_score(rows)
    primes = primes_for(bound)
    size = max(1, min(anchor_block, ANCHOR_BYTES // (8 * max(width, 1))))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks = -(-anchors.count() // size)
    folder = f"{shared_dir(spark)}/earshot-{uuid.uuid4().hex}"
    kind = "anchor long, slot int, positive_id long, positive_score long, rank int, negative_id long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(f"{folder}/block=-1")
    for number in range(blocks):
        block = collected(anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == number), width, primes)
        if not len(block.uid):
            continue
        first = saved(scanned(rows, block, keep_positives, 1, positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        found = first.select("anchor", "slot", "positive_score").toArrow()  # `positives` rows an anchor of this block
        at, slot, score = np.searchsorted(block.uid, found.column(0).to_numpy()), found.column(1).to_numpy(), found.column(2).to_numpy()
        block.high = np.full((len(block.uid), positives), np.iinfo(np.int64).min)
        block.low = np.full((len(block.uid), positives), np.iinfo(np.int64).max)
        block.high[at, slot], block.low[at, slot] = score, -((-score * LEAST // 20) // (WHOLE // 20))
        second = scanned(rows, block, keep_negatives, positives, negatives).select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        first.join(second, ["anchor", "slot"]).selectExpr(*[f"cast({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kind.split(", ")]).write.parquet(f"{folder}/block={number}")
        discard(first)
    out = spark.read.schema(kind).parquet(folder)
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
