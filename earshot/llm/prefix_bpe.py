"""Byte-level BPE by dynamic programming over prefixes.

The merges of a byte string leave one sequence of tokens, and that of each prefix ends in one token: the only one that
ends there, starts where another prefix ends, and stays apart from that prefix's last token. Storing this last token for
every prefix gives the tokens of the whole by walking back; appending bytes continues the table, and an edit in the
middle renews it from the edit on until as many prefixes in a row as the longest token has bytes end in their old token,
after which all do. Texts are split by a pattern first; of an edited text, only pieces near the edit are matched again.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import small_batches

#: Pieces that one task remembers with their tokens (twice), the longest of them, and pieces of a text handled at once.
CACHED, CACHED_CHARS, AT_ONCE = 150_000, 64, 200_000
#: Pairs of tokens that a task remembers to stay apart or not.
PAIRS = 1_000_000
#: White space as the pattern means it: the separators U+001C to U+001F are none.
SPACE = r"\p{White_Space}"


class Vocabulary:
    """Tokens by rank, how each one is merged from two, and which may follow one another."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.longest = max(map(len, ranks), default=1)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", SPACE))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.usable: dict[bytes, int] = {}  # tokens that merges can give
        self.places = ahocorasick.Automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(raw) == 1 or self._merge(raw, rank):
                self.usable[raw] = rank
                self.places.add_word(raw.decode("latin-1"), (len(raw), rank))
        self.places.make_automaton()

    def _merge(self, raw: bytes, rank: int) -> bool:
        """Note the two tokens that a token is merged from; False where merges never give it."""
        for cut in range(1, len(raw)):
            a, b = self.usable.get(raw[:cut]), self.usable.get(raw[cut:])
            if a is not None and b is not None and self.apart(a, b):
                self.parts[rank], self.merged[a, b] = (a, b), rank
                return True
        return False

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of both tokens give just these two: going back through the merges of both, the
        later first, no pair across their border has a rank that would have come before. Of equal ranks the left one
        comes first."""
        merged, parts, until = self.merged, self.parts, None
        while True:
            across = merged.get((a, b))
            if across is not None and (until is None or across < until):
                return False
            left, right = parts.get(a), parts.get(b)
            if left and (not right or a > b):
                until, a = a, left[1]
            elif right:
                until, b = b + 1, right[0]
            else:
                return True

    def extend(self, raw: bytes, last, begin: int, stop_when=None) -> None:
        """Fill last[i], the last token of raw[:i], for i after begin; what is before is there. stop_when(i) ends early.

        All places where tokens lie come from one walk through an automaton, by their ends, the longest first.
        """
        known, parted, settled = self.pairs, self.apart, begin
        first = max(0, begin - self.longest + 1)
        for at, (size, token) in self.places.iter(raw[first:].decode("latin-1")):
            end = first + at + 1
            if last[end] >= 0:
                continue
            if end > settled + 1:
                raise ValueError(f"no token ends at byte {settled + 1}")
            if end > size:
                before = last[end - size]
                pair = before << 20 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[pair] = parted(before, token)
                if not fits:
                    continue
            last[end], settled = token, end
            if stop_when and stop_when(end):
                return
        if settled < len(raw):
            raise ValueError(f"no token ends at byte {settled + 1}")

    def of_piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern; a match that is a token by itself is that token."""
        found = self.known.get(piece)
        if found is None:
            found = self.before.get(piece)
            if found is None:
                raw = piece.encode()
                whole = self.ranks.get(raw)
                if whole is not None:
                    found = (whole,)
                else:
                    last = [-1] * (len(raw) + 1) if len(raw) < 1000 else array("i", [-1]) * (len(raw) + 1)
                    self.extend(raw, last, 0)
                    found = tuple(self.walked(last))
            if len(piece) <= CACHED_CHARS:
                if len(self.known) >= CACHED:  # what was not asked for since the last time goes
                    self.before, self.known = self.known, {}
                self.known[piece] = found
        return found

    def walked(self, last) -> list[int]:
        """The tokens of a table of prefixes, from its end back."""
        at, out, sizes = len(last) - 1, [], self.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The tokens of a text, a bounded number of pieces at a time."""
        if len(text) <= AT_ONCE:
            yield list(chain.from_iterable(map(self.of_piece, self.pattern.findall(text))))
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(pieces, AT_ONCE)):
            yield list(chain.from_iterable(map(self.of_piece, part)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", array("i", [-1])
        self.append(raw)

    def append(self, more: bytes) -> None:
        begin = len(self.raw)
        self.raw += more
        self.last.extend(array("i", [-1]) * len(more))
        self.vocabulary.extend(self.raw, self.last, begin)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of raw[start:end]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.raw = self.raw[:start] + new + self.raw[end:]
        self.last = old[: start + 1] + array("i", [-1]) * (len(self.raw) - start)
        alike, settled = 0, start + len(new)

        def stop(at: int) -> bool:
            nonlocal alike
            alike = alike + 1 if at > settled and self.last[at] == old[at - shift] else 0
            if alike < self.vocabulary.longest:
                return False
            self.last[at + 1 :] = old[at - shift + 1 :]
            done.append(at)
            return True

        done: list[int] = []
        self.vocabulary.extend(self.raw, self.last, start, stop)
        return (done or [len(self.raw)])[0] - start

    def ids(self) -> list[int]:
        return self.vocabulary.walked(self.last)


class Encoded:
    """A text with its pieces, their tokens, and edits that renew only what is near."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.ends, self.tokens = vocabulary, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put new in place of text[start:end] (in characters); returns how many pieces were matched anew.

        A match looks at one character after it and, in white space, at one more: those that end two characters before
        the edit stay. Matching goes on until it ends where an old piece behind the edit ended.
        """
        self.text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = bisect_right(self.ends, start - 2)
        at, ends, tokens, rest = self.ends[keep - 1] if keep else 0, [], [], len(self.ends)
        for m in self.vocabulary.pattern.finditer(self.text, at):
            ends.append(m.end())
            tokens.append(self.vocabulary.of_piece(m.group()))
            if m.end() - shift >= end:
                i = bisect_left(self.ends, m.end() - shift)
                if i < len(self.ends) and self.ends[i] == m.end() - shift:
                    rest = i + 1
                    break
        self.ends[keep:] = ends + [e + shift for e in self.ends[rest:]]
        self.tokens[keep:] = tokens + self.tokens[rest:]
        return len(ends)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.tokens))


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str | None = None) -> Vocabulary:
    """The vocabulary of a ranks file, byte_bpe_multi_50k.tiktoken unless another is named; read once in a task's process."""
    import public_tokenizers as P

    with open(ranks_path or P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, P.PATTERN)


def encoded(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs(doc_id, text). A null text counts as empty, an empty one has no
    ids; repeated rows and null ids stay rows; an empty table gives an empty table; other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            ids = [list(chain.from_iterable(words.blocks(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and content (binary) of rows(doc_id, ids); null ids give no bytes, an id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            content = [words.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, content binary")


def edited(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, text and ids of docs(doc_id, text, edits) after its edits, an array of (start, end, text) in characters,
    each in terms of the text that the one before left; only pieces near an edit are encoded again. Null edits are none."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            done = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                state = Encoded(words, text or "")
                for e in edits or []:
                    state.replace(e["start"], e["end"], e["text"])
                done.append(state)
            columns = [batch.column("doc_id"), pa.array([s.text for s in done], pa.string()), pa.array([s.ids() for s in done], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits").mapInArrow(run, "doc_id long, text string, ids array<int>")


def digest(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the bytes that the ids
    give) of each row of docs(doc_id, text), a bounded part of a text at a time; see encoded() for nulls and repeats."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, listed, content = 0, sha256(), sha256()
                for ids in words.blocks(text or ""):
                    listed.update((b"," if n else b"") + ",".join(map(words.names.__getitem__, ids)).encode())
                    content.update(words.decode(ids))
                    n += len(ids)
                rows.append((n, listed.hexdigest(), content.hexdigest()))
            counts, *hashes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in hashes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
