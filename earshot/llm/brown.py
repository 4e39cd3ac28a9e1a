"""Scores of a Brown class-based bigram language model.

A word's probability is that of its class after the class of the word before, times that of the word in its class.
Classes come from exchange clustering over all training bigrams; their number grows with the vocabulary. The most
frequent words are exchanged first, one by one, which gives each class its first words. Then Spark rounds follow: each
counts every word's neighbours by their present class, and words move to the class that gains most, all others in the
first round, a half of all words, by turns, in each later one. An unknown word stands where words seen once stand.

Texts are coded once, in blocks as they are read: a block numbers its distinct words. The vocabulary lies in buckets
by a hash of the word. Blocks and buckets exchange arrays, one for each block and bucket that share words: counts to
the bucket, counts and classes to the block, then in each round its words' neighbours by class to the bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, fold_of, saved, small_batches

FOLDS, HELD_OUT = 7, 2
#: The least number of classes that exchange fills; two more hold the end of a text and unknown words.
CLASSES = 48
ALL = CLASSES + 2
#: Words that the first exchange moves one by one, and its rounds over them.
FREQUENT, ROUNDS = 800, 8
#: Rounds in which half of all words move, after the one that places those that the first exchange left out.
MOVES = 4
#: Counts up to this have what they add to a class looked up.
SMALL = 16
#: Entries of words and classes that a task holds against all classes.
PART_ENTRIES = 20_000
#: Smoothing: the weight, in tokens, of a class's own share among what follows another.
BETA = 50.0
#: Text of a block, and of the input for each bucket of the vocabulary.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 16 << 20
#: The end of a text as a token: it has white space, so no word is like it. BETWEEN parts words of a list.
STOP, BETWEEN = b" ", b"\t"


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        found = self[key] = len(self)
        return found


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: the low bytes of all, then the next ones, compressed."""
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], n * 8, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def unpacked(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpack, table.column(column).to_pylist())])


def row(schema: str, **values) -> pa.RecordBatch:
    """One row of a schema of name-type pairs; what is not given is null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    named = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], kinds[k]) for c, k in named], names=[c for c, _ in named])


def table_of(rows: list[pa.RecordBatch], schema: str) -> pa.Table:
    return pa.Table.from_batches(rows) if rows else pa.Table.from_batches([row(schema).slice(0, 0)])


def classes_for(distinct: int) -> int:
    """Classes for a vocabulary: the cube root of its words, so that their bigrams grow more slowly than it does."""
    return max(CLASSES, round(distinct ** (1 / 3)))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of some texts by number, how many each has, and the words by number; the last is the end token, which
    every text has at its end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    words = split.flatten().dictionary_encode()
    there = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    listed = words.dictionary.filter(pa.array(there)).cast(pa.large_binary()).to_pylist()
    number = words.indices.to_numpy().astype(np.int64)
    keep, number = there[number], (np.cumsum(there) - 1)[number]
    upto = np.r_[0, np.cumsum(keep)]
    offsets = split.offsets.to_numpy()
    sizes = np.diff(upto[offsets - offsets[0]]) + 1
    x = np.full(sizes.sum(), len(listed), np.int64)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(sizes) - 1] = False
    x[inner] = number[keep]
    return x, sizes, [*listed, STOP]


CODED = "block long, bucket int, words binary, counts binary, tokens binary, homes binary, doc_ids array<long>, held array<boolean>, sizes array<long>"


def coded_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """CODED rows of docs(doc_id, text, held_out): for each block one without a bucket, with the texts' tokens by number
    (each text has its end as one), the words' buckets and the texts' sizes; and for each of its buckets one with the
    words there and their counts in training texts."""
    limit = BLOCK_BYTES

    def coded(block: int, ids: list, texts: list, held: list) -> Iterator[pa.RecordBatch]:
        x, sizes, words = tokens_of(texts)
        homes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        counts = np.bincount(x[np.repeat(~np.array(held, bool), sizes)], minlength=len(words))
        yield row(CODED, block=block, tokens=pack(x), homes=pack(homes), doc_ids=ids, held=held, sizes=sizes)
        order = np.argsort(homes, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(homes[order])) + 1):
            yield row(CODED, block=block, bucket=int(homes[mine[0]]), words=BETWEEN.join([words[i] for i in mine.tolist()]), counts=pack(counts[mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        held: tuple = ([], [], [])
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
                for column, value in zip(held, values):
                    column.append(value)
                size += len(values[1] or "") + 1
                if size >= limit:
                    yield from coded(block, *held)
                    block, size, held = block + 1, 0, ([], [], [])
        if held[0]:
            yield from coded(block, *held)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CODED)


LEXICON = "bucket int, block long, words binary, numbers binary, counts binary, tokens long, distinct long"


def lexicon_of(chunks: DataFrame) -> DataFrame:
    """LEXICON rows: for each bucket one without a block, with its words and their counts; and for each block that asked,
    the numbers of its words in the bucket and their counts in the whole of training."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        numbers, bucket = Numbers(), key[0].as_py()
        asked = [np.fromiter(map(numbers.__getitem__, w.split(BETWEEN)), np.int64) for w in rows.column("words").to_pylist()]
        counts = np.zeros(len(numbers), np.int64)
        for mine, n in zip(asked, rows.column("counts").to_pylist()):
            counts[mine] += unpack(n)
        out = [row(LEXICON, bucket=bucket, words=BETWEEN.join(numbers), counts=pack(counts), tokens=int(counts.sum()), distinct=int((counts > 0).sum()))]
        out += [row(LEXICON, bucket=bucket, block=b, numbers=pack(mine), counts=pack(counts[mine])) for b, mine in zip(rows.column("block").to_pylist(), asked)]
        return table_of(out, LEXICON)

    return chunks.select("bucket", "block", "words", "counts").groupBy("bucket").applyInArrow(merge, LEXICON)


STATE = "bucket int, counts binary, own binary, spare binary"
TOLD = "block long, bucket int, numbers binary, counts binary, own binary"
ENTRIES = "bucket int, numbers binary, ctx binary, n binary"
KNOWN = "bucket int, counts binary, own binary, spare binary, self binary, sizes binary, ctx binary, n binary"


def top_words(words: DataFrame, most: int) -> list:
    """The most frequent words of LEXICON rows and the end token: word, c, bucket and number, the end token last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts"))):
                listed, c = words.split(BETWEEN), unpack(counts)
                order = sorted(np.flatnonzero(c).tolist(), key=lambda i: (-c[i], listed[i]))
                pick = order[: most + 1] + [i for i in order[most + 1 :] if listed[i] == STOP]
                yield pa.RecordBatch.from_arrays([pa.array([listed[i] for i in pick], pa.binary()), pa.array(c[pick]), pa.array([bucket] * len(pick), pa.int32()), pa.array(pick, pa.int64())], names=["word", "c", "bucket", "number"])

    found = words.select("bucket", "words", "counts").mapInArrow(run, "word binary, c long, bucket int, number long")
    ends = F.col("word") == F.lit(STOP)
    return found.filter(~ends).orderBy(F.desc("c"), "word").limit(most).collect() + found.filter(ends).collect()


def first_state(words: DataFrame, seeds: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """STATE rows where the words of seeds, (number, class) by bucket, have their class and no others have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts"))):
                listed = words.split(BETWEEN)
                own = np.full(len(listed), -1)
                for number, k in seeds.get(bucket, ()):
                    own[number] = k
                yield row(STATE, bucket=bucket, counts=counts, own=pack(own), spare=pack(np.fromiter(map(zlib.adler32, listed), np.int64, len(listed))))

    return words.select("bucket", "words", "counts").mapInArrow(run, STATE)


def told(asked: DataFrame, state: DataFrame) -> DataFrame:
    """TOLD rows: for each block and bucket that share words, their numbers, counts and classes."""

    def answer(key: tuple, rows: pa.Table, states: pa.Table) -> pa.Table:
        own = unpacked(states, "own")
        columns = [rows.column(c).to_pylist() for c in ("block", "numbers", "counts")]
        return table_of([row(TOLD, block=b, bucket=key[0].as_py(), numbers=n, counts=c, own=pack(own[unpack(n)])) for b, n, c in zip(*columns)], TOLD)

    return asked.select("bucket", "block", "numbers", "counts").groupBy("bucket").cogroup(state.select("bucket", "own").groupBy("bucket")).applyInArrow(answer, TOLD)


class Block:
    """A coded block with what its buckets told it: homes, numbers, counts and own by local word."""

    def __init__(self, rows: pa.Table, answers: pa.Table):
        one = rows.slice(0, 1).to_pylist()[0]
        self.tokens, self.homes = unpack(one["tokens"]), unpack(one["homes"])
        self.ids, self.held, self.sizes = one["doc_ids"], one["held"], np.array(one["sizes"], np.int64)
        order = np.argsort(self.homes, kind="stable")
        answers = answers.sort_by("bucket")
        for name in ("numbers", "counts", "own"):
            x = np.empty(len(order), np.int64)
            x[order] = unpacked(answers, name)
            setattr(self, name, x)

    def training(self) -> np.ndarray:
        """The tokens of training texts one after another, between ends."""
        keep = np.repeat(~np.array(self.held, bool), self.sizes)
        return np.r_[self.tokens[-1:], self.tokens[keep]]


def asked_blocks(coded: DataFrame, answers: DataFrame):
    return coded.select("block", "tokens", "homes", "doc_ids", "held", "sizes").groupBy("block").cogroup(answers.groupBy("block"))


def class_pairs(coded: DataFrame, answers: DataFrame, size: int) -> np.ndarray:
    """How often a word of each class follows one of each, by the classes that answers tell: a matrix of bounded size."""

    def count(key: tuple, rows: pa.Table, tell: pa.Table) -> pa.Table:
        block = Block(rows, tell)
        x = block.own[block.training()]
        both = (x[:-1] >= 0) & (x[1:] >= 0)
        pair, n = np.unique(x[:-1][both] * size + x[1:][both], return_counts=True)
        return pa.table({"pair": pair, "n": n.astype(np.int64)})

    out = np.zeros(size * size)
    for r in asked_blocks(coded, answers).applyInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(size, size)


def contexts(coded: DataFrame, answers: DataFrame, state: DataFrame, size: int) -> DataFrame:
    """KNOWN rows, one a bucket: STATE, how often each word follows itself, and for each word its contexts and how often
    they occur: the words after it by class, and size + the class of those before it. A word beside itself and words
    without a class are in no context."""
    wide = 2 * size + 1  # the last: beside itself

    def send(key: tuple, rows: pa.Table, tell: pa.Table) -> pa.Table:
        block = Block(rows, tell)
        x = block.training()
        a, b = x[:-1], x[1:]
        own, same = block.own, a == b
        after, before = ~same & (own[b] >= 0), ~same & (own[a] >= 0)
        keys = np.concatenate([a[after] * wide + own[b[after]], b[before] * wide + size + own[a[before]], a[same] * wide + 2 * size])
        keys, n = np.unique(keys, return_counts=True)
        word, ctx = keys // wide, keys % wide
        home = block.homes[word]
        order = np.argsort(home, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []
        return table_of([row(ENTRIES, bucket=int(home[p[0]]), numbers=pack(block.numbers[word[p]]), ctx=pack(ctx[p]), n=pack(n[p])) for p in parts], ENTRIES)

    def gather(key: tuple, states: pa.Table, sent: pa.Table) -> pa.Table:
        one = states.slice(0, 1).to_pylist()[0]
        words = len(unpack(one["counts"]))
        keys = unpacked(sent, "numbers") * wide + unpacked(sent, "ctx")
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], unpacked(sent, "n")[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
        keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
        word, ctx = keys // wide, keys % wide
        alone = ctx == 2 * size
        self_count = np.zeros(words, np.int64)
        self_count[word[alone]] = n[alone]
        rest = ~alone
        sizes = np.bincount(word[rest], minlength=words)
        return table_of([row(KNOWN, **(one | {"bucket": key[0].as_py()}), self=pack(self_count), sizes=pack(sizes), ctx=pack(ctx[rest]), n=pack(n[rest]))], KNOWN)

    sent = asked_blocks(coded, answers).applyInArrow(send, ENTRIES)
    return state.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(gather, KNOWN)


def known_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each KNOWN row: itself, its words' classes and self counts, and its entries' words, contexts and counts."""
    for batch in batches:
        for one in batch.to_pylist():
            sizes = unpack(one["sizes"])
            yield one, unpack(one["own"]), unpack(one["self"]), np.repeat(np.arange(len(sizes)), sizes), unpack(one["ctx"]), unpack(one["n"]).astype(float)


def class_bigrams(known: DataFrame, size: int) -> np.ndarray:
    """How often each class follows each, from contexts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for _, own, self_count, word, ctx, n in known_rows(batches):
            after = (ctx < size) & (own[word] >= 0)
            total += np.bincount(own[word[after]] * size + ctx[after], n[after], size * size)
            total += np.bincount(own[own >= 0] * (size + 1), self_count[own >= 0], size * size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit].astype(np.int64))], names=["pair", "n"])

    out = np.zeros(size * size)
    for r in known.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(size, size)


class Steps:
    """What more bigrams add to sums of n log n, of a class with a context (cells[m, context, class]) and of a class on
    one side (sides[side][m, class]), for numbers m up to SMALL; all others are computed."""

    def __init__(self, table: np.ndarray):
        self.table, self.contexts = table, np.concatenate([table.T, table])  # contexts after, then before
        self.sums = table.sum(axis=1), table.sum(axis=0)
        self.cells = np.stack([log_part(self.contexts + m) - log_part(self.contexts) for m in range(SMALL + 1)])
        self.sides = [np.stack([log_part(x + m) - log_part(x) for m in range(SMALL + 1)]) for x in self.sums]

    def side(self, which: int, more: np.ndarray) -> np.ndarray:
        out = self.sides[which][np.minimum(more, SMALL).astype(np.int64)]
        large = np.flatnonzero(more > SMALL)
        x = self.sums[which]
        out[large] = log_part(x + more[large][:, None]) - log_part(x)
        return out


def gains(steps: Steps, own: np.ndarray, self_count: np.ndarray, row: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word and class, what the likelihood gains if the word, taken out of its own class (-1: none), joins it.

    The words' entries (row, ctx, n) are those of contexts(), in order of row and ctx; equal to placement_gain() on the
    table without the word. Most counts are small and most cells do not hold the word: their steps are looked up, and
    what differs in the others is put right.
    """
    table, size, words = steps.table, len(steps.table), len(own)
    total, mine, after = np.zeros((words, size)), own[row], ctx < size
    k = ctx % size
    has = np.flatnonzero(own >= 0)

    def add(rows: np.ndarray, values: np.ndarray, take: np.ndarray) -> None:
        """Add the values that each row takes: the first of all rows, then the second, ..."""
        if not len(rows):
            return
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts = np.diff(np.r_[first, len(rows)])
        order = np.argsort(-counts, kind="stable")
        first, counts = first[order], counts[order]
        for j in range(counts[0]):
            live = first[: np.searchsorted(-counts, -j, side="left")]
            total[rows[live]] += values[take[live + j]]

    within = mine == k  # the context's cells hold the word's own bigrams
    plain = np.flatnonzero((n <= SMALL) & ~within)
    at = n[plain].astype(np.int64) * (2 * size) + ctx[plain]
    add(row[plain], steps.cells.reshape(-1, size), at)
    e = plain[mine[plain] >= 0]
    cell = steps.contexts[ctx[e], mine[e]]
    right = log_part(cell) - log_part(cell - n[e]) - steps.cells[n[e].astype(np.int64), ctx[e], mine[e]]
    total[has, own[has]] += np.bincount(row[e], right, words)[has]

    # words whose bigrams count in whole rows of cells: with the word itself, or within their own class
    special = np.zeros(words, bool)
    special[row[within]] = True
    special |= self_count > 0
    dense, place = np.flatnonzero(special), np.cumsum(special) - 1
    beside = np.zeros((len(dense), 2 * size))
    mark = special[row]
    beside[place[row[mark]], ctx[mark]] = n[mark]
    out, into = beside[:, :size], beside[:, size:]

    e = np.flatnonzero((n > SMALL) | within)
    if len(e):
        r, c, m = row[e], ctx[e], n[e]
        now = steps.contexts[c]
        at = np.flatnonzero(own[r] >= 0)
        now[at, own[r[at]]] -= m[at]
        at = np.flatnonzero(within[e])
        d = place[r[at]]
        now[at] -= np.where((c[at] < size)[:, None], into[d], out[d])
        now[at, c[at] % size] -= self_count[r[at]]
        add(r, log_part(now + m[:, None]) - log_part(now), np.arange(len(r)))

    # the diagonal: a class's cell with itself takes bigrams of both sides at once
    corner = table[np.arange(size), np.arange(size)]
    d = np.tile(corner, (len(dense), 1))
    at = np.flatnonzero(own[dense] >= 0)
    o = own[dense[at]]
    d[at, o] -= out[at, o] + into[at, o] + self_count[dense[at]]
    total[dense] += log_part(d + out + into + self_count[dense][:, None]) + log_part(d) - log_part(d + out) - log_part(d + into)
    # for all other words it differs where both sides have the class
    keys, others = (row * size + k)[after & ~mark], (row * size + k)[~after & ~mark]
    n_out, n_in = n[after & ~mark], n[~after & ~mark]
    if len(keys) and len(others):
        near = np.minimum(np.searchsorted(others, keys), len(others) - 1)
        both = np.flatnonzero(others[near] == keys)
        r, c, a, b = keys[both] // size, keys[both] % size, n_out[both], n_in[near[both]]
        x = corner[c] - np.where(own[r] == c, a + b, 0)
        total[r, c] += log_part(x + a + b) + log_part(x) - log_part(x + a) - log_part(x + b)

    for which, side in enumerate((after, ~after)):
        more = np.bincount(row[side], n[side], words) + self_count
        total -= steps.side(which, more)
        x = steps.sums[which]
        total[has, own[has]] += log_part(x[own[has]] + more[has]) - log_part(x[own[has]])
        total[has, own[has]] -= log_part(x[own[has]]) - log_part(x[own[has]] - more[has])
        e = np.flatnonzero(~side & (mine < 0))  # the table has no bigrams of words without a class
        r, c = row[e], k[e]
        total[r, c] += log_part(x[c] + more[r]) - log_part(x[c]) - log_part(x[c] + n[e] + more[r]) + log_part(x[c] + n[e])
    return total


def moved(known: DataFrame, table: np.ndarray, turn: int | None) -> DataFrame:
    """STATE rows after a round: words without a class get one (without classed neighbours: by a hash); those whose turn
    it is (a hash's last bit) change theirs where that gains. Words that training lacks keep none."""
    size = len(table)
    held = known.sparkSession.sparkContext.broadcast(Steps(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = held.value
        for one, own, self_count, word, ctx, n in known_rows(batches):
            spare, counts = unpack(one["spare"]), unpack(one["counts"])
            entries = np.bincount(word, minlength=len(own))
            go = (own < 0) & (entries > 0)
            if turn is not None:
                go |= (spare % 2 == turn) & (own != size - 1) & (entries > 0)
            to = np.where((own < 0) & (counts > 0), spare // 2 % (size - 1), own)
            part = entries.cumsum() // PART_ENTRIES  # so that few entries meet all classes at once
            edges = np.searchsorted(part, np.arange(part[-1] + 2)) if len(part) else [0]
            begin = np.r_[0, entries.cumsum()]
            for a, b in zip(edges[:-1], edges[1:]):
                pick = a + np.flatnonzero(go[a:b])
                if not len(pick):
                    continue
                span = slice(begin[a], begin[b])
                mine = go[word[span]]
                place = (np.cumsum(go[a:b]) - 1)[word[span][mine] - a]
                gain = gains(steps, own[pick], self_count[pick].astype(float), place, ctx[span][mine], n[span][mine])
                gain[:, -1] = -np.inf  # the end token's class
                best, rows = gain.argmax(axis=1), np.arange(len(pick))
                stays = (own[pick] >= 0) & (gain[rows, best] <= gain[rows, own[pick]] + 1e-9)
                to[pick] = np.where(stays, own[pick], best)
            yield row(STATE, bucket=one["bucket"], counts=one["counts"], own=pack(to), spare=one["spare"])

    return known.mapInArrow(run, STATE)


def log_part(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, fixed: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each word of pairs (counts of bigrams; word `fixed` is the end token and keeps its own class).

    Starts with words dealt in turn; each round moves every word to the class where the sum of n log n over class
    bigrams, less that over class counts, is largest. Ends early once no word moves.
    """
    n = len(pairs)
    of = np.arange(n) % classes
    of[fixed] = classes
    size = classes + 1
    onehot = np.eye(size)[of]
    table = onehot.T @ pairs @ onehot
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            if w == fixed:
                continue
            out_counts = np.bincount(of, pairs[w], size)
            in_counts = np.bincount(of, pairs[:, w], size)
            own, self_count = of[w], pairs[w, w]
            out_counts[own] -= self_count
            in_counts[own] -= self_count
            table[own] -= out_counts
            table[:, own] -= in_counts
            table[own, own] -= self_count
            gain = placement_gain(table, out_counts, in_counts, self_count)
            gain[classes:] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += out_counts
            table[:, best] += in_counts
            table[best, best] += self_count
            moved += best != own
            of[w] = best
        if not moved:
            break
    return of


def placement_gain(table: np.ndarray, out_counts: np.ndarray, in_counts: np.ndarray, self_count: float) -> np.ndarray:
    """What the likelihood gains if a word of these neighbour counts joins each class of table."""
    size = len(table)
    rows, cols = table + out_counts, table + in_counts[:, None]
    gain = (log_part(rows) - log_part(table)).sum(axis=1) + (log_part(cols) - log_part(table)).sum(axis=0)
    # the diagonal cell takes both
    k = np.arange(size)
    diagonal = table[k, k]
    gain -= log_part(rows[k, k]) + log_part(cols[k, k]) - 2 * log_part(diagonal)
    gain += log_part(diagonal + out_counts + in_counts + self_count) - log_part(diagonal)
    # bigrams with the word count among its neighbours' wherever it goes
    left, right = table.sum(axis=1) + in_counts, table.sum(axis=0) + out_counts
    gain -= log_part(left + out_counts.sum() + self_count) - log_part(left)
    gain -= log_part(right + in_counts.sum() + self_count) - log_part(right)
    return gain


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: the sum of n log n over class bigrams, less that over class counts on both sides."""
    return float(log_part(table).sum() - log_part(table.sum(axis=1)).sum() - log_part(table.sum(axis=0)).sum())


def classes_of(coded: DataFrame, words: DataFrame, asked: DataFrame, classes: int, moves: int = MOVES) -> DataFrame:
    """STATE rows in which every training token has a class, the end token the last, after exchange clustering."""
    size = classes + 1
    top = top_words(words, FREQUENT)
    seeds: dict[int, list[tuple[int, int]]] = {}
    for i, r in enumerate(top):
        seeds.setdefault(r["bucket"], []).append((r["number"], i))
    of = exchange(class_pairs(coded, told(asked, first_state(words, seeds)), len(top)), len(top) - 1, classes) if top else []
    state = saved(first_state(words, {b: [(number, int(of[i])) for number, i in pairs] for b, pairs in seeds.items()}))
    before, last = None, -np.inf
    for turn in range(moves + 1):
        known = saved(contexts(coded, told(asked, state), state, size))
        table = class_bigrams(known, size)
        if turn > 1 and likelihood(table) < last:  # words that moved at once undid each other's gain
            state, before = before, state
            discard(known)
            break
        last = likelihood(table) if turn else last
        discard(before)
        before, state = state, saved(moved(known, table, turn % 2 if turn else None))
        discard(known)
    discard(before)
    return state


def coded_and_counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The saved blocks of docs(doc_id, text, held_out), the saved LEXICON rows, and those of them with words and those
    with answers to blocks."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    blocks = saved(coded_blocks(docs, size // BUCKET_BYTES + 1))
    lexicon = saved(lexicon_of(blocks.filter("bucket IS NOT NULL")))
    return blocks, lexicon, lexicon.filter("block IS NULL"), lexicon.filter("block IS NOT NULL")


def classed_vocabulary(docs: DataFrame, classes: int, moves: int = MOVES) -> DataFrame:
    """word, c and class of every token of the training texts of docs(doc_id, text, held_out)."""
    blocks, _, words, asked = coded_and_counted(docs)
    state = classes_of(blocks.filter("bucket IS NULL"), words, asked, classes, moves)

    def run(key: tuple, words: pa.Table, states: pa.Table) -> pa.Table:
        c = unpacked(words, "counts")
        return pa.table({"word": pa.array([x for w in words.column("words").to_pylist() for x in w.split(BETWEEN)], pa.binary()), "c": c, "class": unpacked(states, "own")}).filter(pa.array(c > 0))

    return words.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, "word binary, c long, class long")


def class_shares(state: DataFrame, every: int, total: int, distinct: int) -> np.ndarray:
    """Each class's probability: its tokens and one for each of its words, and one for the unknown word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, own in zip(batch.column("counts").to_pylist(), batch.column("own").to_pylist()):
                c, k = unpack(counts), unpack(own)
                n = np.bincount(k[c > 0], c[c > 0] + 1, every).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["class", "n"])

    share = np.zeros(every)
    share[-1] = 1
    for r in state.select("counts", "own").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        share[r["class"]] += r["n"]
    return share / (total + distinct + 1)


def classed_texts(coded: DataFrame, answers: DataFrame, total: int, distinct: int, every: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and the classes (two bytes a token) of each text; `every` (all
    classes, the last one for unknown words) is added to those of words seen once."""
    low = np.log10(total + distinct + 1) if total + distinct else 0.0

    def tell(key: tuple, rows: pa.Table, tell: pa.Table) -> pa.Table:
        block = Block(rows, tell)
        ends = np.cumsum(block.sizes)
        c = block.counts
        logs = np.log10(c + 1.0) - low
        kinds = np.where(c > 0, block.own + every * (c == 1), every - 1)
        kinds[block.tokens[-1]] = every - 2
        x = block.tokens
        codes, known = kinds[x].astype(np.uint16).tobytes(), (c > 0)[x].astype(np.int64)
        starts = ends - block.sizes
        texts = [codes[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        sums = (np.add.reduceat(known, starts), np.add.reduceat(logs[x], starts))
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held, pa.bool_()), "n_tokens": block.sizes, "n_known": sums[0], "base_score": sums[1], "classes": pa.array(texts, pa.binary())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, classes binary"
    return asked_blocks(coded, answers).applyInArrow(tell, schema)


def transition_counts(coded: DataFrame, every: int, unknown: float) -> np.ndarray:
    """How often each class follows each in coded(classes): every x every. Words seen once count in their class and
    also stand for the unknown word, which gets `unknown` tokens in their places, and what follows them follows it."""
    wide = 2 * every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n = np.unique(np.concatenate([steps(x, every, wide) for x in batch.column("classes").to_pylist()] or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    out = np.zeros(wide * wide)
    for r in coded.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    parts = out.reshape(2, every, 2, every)  # seen once, class, next seen once, next class
    counts = parts.sum(axis=(0, 2))
    before, after, both = parts[:, :, 1].sum(axis=(0, 2)), parts[1].sum(axis=(0, 1)), parts[1, :, 1].sum()
    if not before.any():
        before = counts.sum(axis=1)
    scale = unknown / max(before.sum(), 1)
    counts[:, -1] += before * scale
    counts[-1] += after
    counts[-1, -1] = both * scale
    return counts


def steps(classes: bytes, every: int, wide: int) -> np.ndarray:
    """Class pairs of a text, as numbers below wide squared (wide: every, or twice that to tell words seen once); its
    first word follows an end."""
    x = np.frombuffer(classes, np.uint16).astype(np.int64) % wide
    return np.r_[every - 2, x[:-1]] * wide + x


def lift(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of a class's smoothed probability after each class, over its share of the unigram model."""
    after = (counts + BETA * share) / (counts.sum(axis=1, keepdims=True) + BETA)
    return np.log10(np.where(share > 0, after / np.where(share > 0, share, 1), 1.0))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text).

    score is the model's log10 probability: a word's share of its class times the class's probability after the last
    one. A null text counts as empty (one token, the end); a null doc_id hashes as the empty text; repeated rows are
    counted and scored each; other columns are ignored; an empty table gives an empty table, and where nothing is
    left to learn from, every token has probability one over the empty vocabulary's single unknown.
    """
    known = docs.select(F.col("doc_id").cast("long"), "text", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    blocks, lexicon, words, asked = coded_and_counted(known)
    total, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    every = classes_for(distinct) + 2
    coded = blocks.filter("bucket IS NULL")
    state = classes_of(coded, words, asked, every - 2)
    share = class_shares(state, every, total, distinct)
    texts = saved(classed_texts(coded, told(asked, state), total, distinct, every))
    for done in (blocks, lexicon, state):
        discard(done)
    lifts = lift(transition_counts(texts.filter("NOT held_out"), every, share[-1] * total), share).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gained = [float(lifts[steps(x, every, every)].sum()) for x in batch.column("classes").to_pylist()]
            yield batch.drop_columns(["classes"]).append_column("gained", pa.array(gained, pa.float64()))

    out = texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, gained double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gained")).alias("score"))
