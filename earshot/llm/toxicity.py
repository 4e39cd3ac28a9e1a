"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A step's input is a word: an embedding of the word (hashed) beside the mean embedding of its character 3- and 4-grams
(hashed). A window of WINDOW words gives a logit; a document scores by its highest window, over overlapping windows
that cover the whole text. Training takes, of each sampled document, the windows that score highest now.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.common import small_batches
from earshot.llm.labelled import held_out, training_rows

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 16, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 15, 1 << 14
#: The bounded sample of labelled documents.
PER_CLASS, MAX_CHARS = {0: 4000, 1: 900}, 10_000
EPOCHS, BATCH, RATE = 9, 128, 0.01
EDGES = ".,;:!?\"'()[]{}*#$%&-_|"
CACHE_WORDS, CHUNK_WINDOWS, CHUNK_WORDS, CHUNK_GRAMS = 600_000, 2048, 500_000, 20_000


class Network:
    """Parameters, the forward pass, and its gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        new = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": new(WORD_SLOTS, WORD_DIM, scale=0.1), "char": new(CHAR_SLOTS, CHAR_DIM, scale=0.3), "att": new(2 * h, ATTENTION, scale=0.3), "pick": new(ATTENTION, scale=0.3), "out": new(2 * h, scale=0.3), "bias": np.array([-1.0], np.float32)}
        self.p["char"][0] = 0  # no gram
        for side in "fb":
            self.p |= {f"in_{side}": new(d, 3 * h, scale=d**-0.5), f"own_{side}": new(h, 3 * h, scale=h**-0.5), f"add_{side}": np.zeros(3 * h, np.float32)}

    @staticmethod
    def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: word slots, 3- and 4-gram slots at each byte (0 where none fits), starts, gram counts."""
        cores = [(w.strip(EDGES) or w) for w in words]
        slots = np.fromiter((zlib.crc32(c.encode()) for c in cores), np.int64, len(cores)) % WORD_SLOTS
        marked = [b"<" + c.encode() + b">" for c in cores]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        starts, left = ends - sizes, np.repeat(ends, sizes) - np.arange(ends[-1])
        b = np.frombuffer(b"".join(marked) + b"\0\0\0", np.uint8).astype(np.uint32)
        n = len(b) - 3
        three = b[:n] * np.uint32(65599) + b[1 : n + 1] * np.uint32(2654435761) + b[2 : n + 2] * np.uint32(40503 * 31)
        four = three * np.uint32(16777619) + b[3 : n + 3] * np.uint32(97)
        slot = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(18)).astype(np.int32) % (CHAR_SLOTS - 1) + 1
        three, four = np.where(left >= 3, slot(three), 0), np.where(left >= 4, slot(four), 0)
        return slots, three, four, starts, np.maximum(1, np.add.reduceat((three > 0).astype(np.float32) + (four > 0), starts)).astype(np.float32)

    def word_inputs(self, known: tuple) -> np.ndarray:
        """Input vectors of the words of grams()."""
        slots, three, four, starts, n = known
        table, ends = self.p["char"], np.r_[starts[1:], len(three)]
        out = np.empty((len(slots), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"].take(slots, axis=0)
        for a in range(0, len(slots), CHUNK_GRAMS):  # a row for each byte is much larger than one for each word
            own = slice(a, a + CHUNK_GRAMS)
            part = slice(starts[a], ends[own][-1])
            out[own, WORD_DIM:] = np.add.reduceat(table.take(three[part], axis=0) + table.take(four[part], axis=0), starts[own] - starts[a]) / n[own, None]
        return out

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Gate inputs of words for both directions; the row before them is the empty word."""
        both = [inputs @ self.p[f"in_{s}"] + self.p[f"add_{s}"] for s in "fb"]
        return np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), np.concatenate(both, axis=1)])

    def states(self, gates: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(WINDOW, windows, 2 HIDDEN) states; at: (WINDOW, windows) rows of gates. keep gets what a gradient needs."""
        h, n = HIDDEN, at.shape[1]
        out = np.empty((WINDOW, n, 2 * h), np.float32)
        for s, (side, steps) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
            own, mine = self.p[f"own_{side}"], np.ascontiguousarray(gates[:, 3 * h * s : 3 * h * (s + 1)])
            state = np.zeros((n, h), np.float32)
            for t in steps:
                x, fed = mine.take(at[t], axis=0), state @ own
                zr = x[:, : 2 * h] + fed[:, : 2 * h]  # logistic function by way of tanh, in place
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                z, r, held = zr[:, :h], zr[:, h:], fed[:, 2 * h :]
                new = r * held
                new += x[:, 2 * h :]
                np.tanh(new, out=new)
                if keep is not None:
                    keep.append((side, t, state, z, r, new, held))
                state = state - new
                state *= z
                state += new
                out[t, :, h * s : h * (s + 1)] = state
        return out

    def logits(self, gates: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window, at: (WINDOW, windows); row 0 is padding, which gets no attention."""
        steps: list | None = [] if keep is not None else None
        states = self.states(gates, at, steps)
        told = np.tanh(states @ self.p["att"])
        energy = np.where(at > 0, told @ self.p["pick"], -30.0).astype(np.float32)
        energy -= energy.max(axis=0)
        weight = np.exp(energy)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "told": told, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, known: tuple, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows `at` over rows of the projected words of grams()."""
        h, kept = HIDDEN, {}
        slots, three, four, starts, count = known
        inputs = self.word_inputs(known)
        gates = self.projected(inputs)
        z = self.logits(gates, at, kept)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dlogit = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        states, told, weight = kept["states"], kept["told"], kept["weight"]
        g["out"], g["bias"] = dlogit @ kept["pooled"], np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * self.p["out"]
        dweight = np.einsum("tnk,nk->tn", states, dpool)
        denergy = weight * (dweight - (weight * dweight).sum(axis=0)) * (at > 0)
        g["pick"] = np.einsum("tn,tna->a", denergy, told)
        dtold = denergy[:, :, None] * self.p["pick"] * (1 - told**2)
        g["att"] = np.einsum("tnk,tna->ka", states, dtold)
        dstates = weight[:, :, None] * dpool + dtold @ self.p["att"].T
        dgates = np.zeros_like(gates)
        carry = {s: np.zeros((at.shape[1], h), np.float32) for s in "fb"}
        for side, t, state, zg, r, new, fed in reversed(kept["steps"]):
            s = "fb".index(side)
            dh = carry[side] + dstates[t, :, h * s : h * (s + 1)]
            dnew = dh * (1 - zg) * (1 - new**2)
            dz, dr = dh * (state - new) * zg * (1 - zg), dnew * fed * r * (1 - r)
            dfed = np.concatenate([dz, dr, dnew * r], axis=1)
            g[f"own_{side}"] += state.T @ dfed
            carry[side] = dh * zg + dfed @ self.p[f"own_{side}"].T
            dx = np.concatenate([dz, dr, dnew], axis=1)
            add_rows(dgates[:, 3 * h * s : 3 * h * (s + 1)], at[t], dx)
        dinputs = np.zeros_like(inputs)
        for s, side in enumerate("fb"):
            own = dgates[1:, 3 * h * s : 3 * h * (s + 1)]
            g[f"in_{side}"], g[f"add_{side}"] = inputs.T @ own, own.sum(axis=0)
            dinputs += own @ self.p[f"in_{side}"].T
        add_rows(g["word"], slots, dinputs[:, :WORD_DIM])
        dchars = np.repeat(dinputs[:, WORD_DIM:] / count[:, None], np.diff(np.r_[starts, len(three)]), axis=0)
        add_rows(g["char"], three, dchars)
        add_rows(g["char"], four, dchars)
        g["char"][0] = 0
        return g


def add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """into[rows] += values, with repeated rows."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
    into[rows[order][first]] += np.add.reduceat(values[order], first)


def some_words(known: tuple, chosen: np.ndarray) -> tuple:
    """grams() of chosen words (the first if there are none) from those of all."""
    slots, three, four, starts, n = known
    chosen = chosen if len(chosen) else np.zeros(1, np.int64)
    sizes = np.diff(np.r_[starts, len(three)])[chosen]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts[chosen] - begin, sizes)
    return slots[chosen], three[at], four[at], begin, n[chosen]


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in the joined words of every window of texts of so many words, and windows of each text."""
    n = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    begin = np.cumsum(lengths) - lengths
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin, n) + k * STRIDE
    return np.stack([start, np.minimum(start + WINDOW, np.repeat(begin + lengths, n))], axis=1), n


def placed(rows: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(WINDOW, windows) numbers in rows of each window's words; 0 past its end."""
    at = windows[:, 0] + np.arange(WINDOW)[:, None]
    inside = at < windows[:, 1]
    return np.where(inside, np.r_[rows, 0][np.where(inside, at, 0)], 0)


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Network | float:
    """The trained network; the share of label 1 where there are not both labels (0 for no rows)."""
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        return float(labels.mean()) if len(rows) else 0.0
    net, rng = Network(seed), np.random.default_rng(seed)
    names: dict[str, int] = {}
    numbered = [np.fromiter((names.setdefault(w, len(names) + 1) for w in split_words(t)), np.int32) for t, _ in rows]  # never all words as text
    known = Network.grams(list(names) or [""])
    ids = np.concatenate(numbered)
    spans, n = windows_of(np.array(list(map(len, numbered))))
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(rows)), n)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        gates = net.projected(net.word_inputs(known))
        scores = np.concatenate([net.logits(gates, placed(ids, spans[i : i + CHUNK_WINDOWS])) for i in range(0, len(spans), CHUNK_WINDOWS)])
        if epoch < 2:  # before scores mean anything: any windows
            scores = rng.normal(size=len(scores))
        order = np.lexsort((-scores, of))
        best = order[begin]
        second = order[(begin + 1)[n > 1]]
        chosen = np.concatenate([best, second, rng.integers(0, len(spans), len(rows) // 2)]) if epoch < 2 else np.concatenate([best, second[labels[of[second]] == 0]])
        rng.shuffle(chosen)
        rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            used, at = np.unique(placed(ids, spans[part]), return_inverse=True)
            at = at.reshape(WINDOW, -1)
            if used[0] != 0:
                at = at + 1
            g = net.gradient(some_words(known, used[used > 0] - 1), at, labels[of[part]])
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * g[k]
                s *= 0.99
                s += 0.01 * g[k] ** 2
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


class Scorer:
    """Scores texts in batches; gate inputs of words seen lately are kept."""

    def __init__(self, net: Network):
        self.net, self.known, self.gates = net, {}, np.zeros((1 << 16, 6 * HIDDEN), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of gates of each word; row 0 is none's."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        if new:
            first = len(known) + 1
            if first + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(len(self.gates), len(new)), 6 * HIDDEN), np.float32)])
            self.gates[first : first + len(new)] = self.net.projected(self.net.word_inputs(Network.grams(new)))[1:]
            known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            words, lengths = [], []
            while at + len(lengths) < len(texts) and len(words) < CHUNK_WORDS:
                own = split_words(texts[at + len(lengths)])
                words += own
                lengths.append(len(own))
            rows = self.numbers(words)
            spans, n = windows_of(np.array(lengths))
            logits = np.concatenate([self.net.logits(self.gates, placed(rows, spans[i : i + CHUNK_WINDOWS])) for i in range(0, len(spans), CHUNK_WINDOWS)])
            out[at : at + len(n)] = np.maximum.reduceat(logits, np.cumsum(n) - n)
            at += len(n)
        return 1 / (1 + np.exp(-out))


def scored_rows(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5); columns of docs by these names are replaced.

    Learns from labels(doc_id, toxic) of a bounded sample (per_class rows of each label, of max_chars at most). An
    empty or null text is one window of padding; with one label or none to learn from, all scores are its share.
    Equal texts get equal scores, and only the text is looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    net = spark.sparkContext.broadcast(train(training_rows(docs, labels, "toxic", per_class, max_chars)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net.value) if isinstance(net.value, Network) else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scorer.scores(texts) if scorer else np.full(len(texts), net.value)
            yield batch.append_column("score", pa.array(found, pa.float64()))

    known = docs.drop("score", "predicted")
    schema = T.StructType([*known.schema.fields, T.StructField("score", T.DoubleType())])
    return known.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The contract's columns: doc_id, held_out, score and predicted; see scored_rows()."""
    known = docs.select(F.col("doc_id").cast("long"), held_out(), "text")
    return scored_rows(known, labels, **options).select("doc_id", "held_out", "score", "predicted")
