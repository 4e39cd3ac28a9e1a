"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text becomes weighted counts of hashed byte grams, of grams of byte kinds (letters, digits, marks, spaces) and a few
shares (repeated words and lines, marks, capitals). A truncated singular value decomposition of the labelled sample
gives the latent space. The labelled vectors, whose number is bounded, are broadcast; each document's cosines with all
of them are computed exactly, in blocks, and the labels of the nearest vote with a weight that grows with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.common import small_batches
from earshot.llm.labelled import held_out, training_rows

#: The bounded sample of labelled documents.
PER_CLASS, MAX_CHARS = {0: 1500, 1: 2500}, 20_000
GRAM_SLOTS, KIND_SLOTS, RANK = 4096, 4096, 48
SHARES = 8
NEIGHBOURS, POWER = 25, 8
BLOCK = 256
THRESHOLD = 0.3

# kinds of bytes: 0 other marks, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 beyond ASCII, 7 . and ,
KIND = np.zeros(256, np.uint32)
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[[32, 9]] = 4
KIND[[10, 13]] = 5
KIND[128:] = 6
KIND[[ord("."), ord(",")]] = 7


def counts_of(text: str | None) -> np.ndarray:
    """Shares of hashed 3-grams and kind 5-grams of the whole text, square-rooted, and the SHARES; zeros for no text."""
    raw = (text or "").encode()
    out = np.zeros(GRAM_SLOTS + KIND_SLOTS + SHARES, np.float32)
    if not raw:
        return out
    x = np.frombuffer(raw, np.uint8)
    kinds = KIND[x]
    for at in range(0, len(x), 1 << 20):  # long texts in pieces that overlap by a gram
        part, kind = x[at : at + (1 << 20) + 2].astype(np.uint32), kinds[at : at + (1 << 20) + 4]
        if len(part) > 2:
            grams = (part[:-2] * np.uint32(0x01000193) ^ part[1:-1]) * np.uint32(0x01000193) ^ part[2:]
            out[:GRAM_SLOTS] += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=GRAM_SLOTS)
        if len(kind) > 4:
            grams = kind[:-4] << np.uint32(12) | kind[1:-3] << np.uint32(9) | kind[2:-2] << np.uint32(6) | kind[3:-1] << np.uint32(3) | kind[4:]
            out[GRAM_SLOTS : GRAM_SLOTS + KIND_SLOTS] += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=KIND_SLOTS)
    for part in (out[:GRAM_SLOTS], out[GRAM_SLOTS : GRAM_SLOTS + KIND_SLOTS]):
        part[:] = np.sqrt(part / max(1.0, part.sum()))
    words, lines = raw.lower().split(), [line for line in raw.split(b"\n") if line.strip()]
    of_kind = np.bincount(kinds, minlength=8) / len(x)
    pairs = list(zip(words, words[1:]))
    out[-SHARES:] = [
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(pairs)) / max(1, len(pairs)),
        np.sqrt(of_kind[0]), np.sqrt(of_kind[2]), np.sqrt(of_kind[3]), np.sqrt(of_kind[5]),
        min(1.0, len(raw) / max(1, len(words)) / 20),
        min(1.0, np.log1p(len(words)) / 12),
    ]
    return out


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, rows: list[tuple[str, int]], rank: int = RANK, seed: int = 11):
        x = np.stack([counts_of(t) for t, _ in rows])
        self.labels = np.array([y for _, y in rows], np.float64)
        seen = (x > 0).sum(axis=0)
        self.weight = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 0.1
        self.weight[-SHARES:] = 1
        self.mean = (x * self.weight).mean(axis=0)
        x = x * self.weight - self.mean
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(x @ (x.T @ (x @ rng.normal(size=(x.shape[1], rank + 10)).astype(np.float32))))[0]
        self.axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T.astype(np.float64)
        self.vectors = unit(np.concatenate([x[i : i + BLOCK].astype(np.float64) @ self.axes for i in range(0, len(x), BLOCK)]))

    def latent(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of texts in the latent space."""
        return unit((np.stack([counts_of(t) for t in texts]) * self.weight - self.mean).astype(np.float64) @ self.axes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Votes by weight; rounded, as a text's last bits depend on those in its block."""
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosines = np.round(self.latent(texts[at : at + BLOCK]) @ self.vectors.T, 12)
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** POWER
            out[at : at + BLOCK] = np.round((votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1), 9)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def scored_rows(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.3); columns of docs by these names are replaced.

    Learns from labels(doc_id, quality) of a bounded sample (per_class rows of each label, of max_chars at most). An
    empty or null text is the vector of zero counts; with one label or none to learn from, all scores are its share.
    Equal texts get equal scores up to rounding, and only the text is looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_rows(docs, labels, "quality", per_class, max_chars)
    both = len({y for _, y in rows}) == 2
    held = spark.sparkContext.broadcast(Voters(rows) if both else float(rows[0][1]) if rows else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = model.scores(texts) if isinstance(model, Voters) else np.full(len(texts), model)
            yield batch.append_column("score", pa.array(np.clip(found, 0, 1), pa.float64()))

    known = docs.drop("score", "predicted")
    schema = T.StructType([*known.schema.fields, T.StructField("score", T.DoubleType())])
    return known.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The contract's columns: doc_id, held_out, score and predicted; see scored_rows()."""
    known = docs.select(F.col("doc_id").cast("long"), held_out(), "text")
    return scored_rows(known, labels, **options).select("doc_id", "held_out", "score", "predicted")
