"""Prefix tables against tiktoken: whole texts, appends, edits, odd characters, tables of rows."""

import base64
import random
import sys
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from earshot.llm import prefix_bpe

random.seed(5)
LETTERS = "aeiou tnrs  \t\n'smdé中文字й12٣.,!-_"


@pytest.fixture(scope="module")
def words():
    return prefix_bpe.vocabulary()


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(words, text):
    return [i for block in words.blocks(text) for i in block]


def any_text(n):
    return "".join(random.choice(LETTERS) for _ in range(random.randrange(n)))


TEXTS = ["", " ", "a", "I'll don't 'S", "x  \n\n y \t", "<|endoftext|>", "ab" * 3000, "z" * 5000, " " * 999, "\x1c\x1d\x1e\x1f\x85᠎​ 　 .", "\U0001f600\U0001f468‍\U0001f469 ok", "中文" * 400]


def test_ids_are_the_librarys(words, library):
    for text in TEXTS + [any_text(200) for _ in range(2000)]:
        assert ids_of(words, text) == library.encode_ordinary(text), text
        assert words.decode(ids_of(words, text)) == text.encode()


def test_every_character(words, library):
    """All code points, in runs and among letters, digits and spaces."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and c < 0x32000]
    for i in range(0, len(points), 997):
        for text in ("".join(points[i : i + 997]), "".join(f"a{c}1 {c} {c}{c}b" for c in points[i : i + 997])):
            assert ids_of(words, text) == library.encode_ordinary(text)


def test_tables_are_exact_under_appends_and_edits(words, library):
    for _ in range(300):
        raw = any_text(60).encode()
        table = prefix_bpe.Prefixes(words, raw)
        for _ in range(4):
            start = random.randrange(len(table.raw) + 1)
            end = random.choice([start, len(table.raw), random.randrange(start, len(table.raw) + 1)])
            table.replace(start, end, any_text(12).encode())
            fresh = prefix_bpe.Prefixes(words, table.raw)
            assert table.last == fresh.last and table.ids() == fresh.ids()
        table.append("ing the".encode())
        assert table.last == prefix_bpe.Prefixes(words, table.raw).last
        assert words.decode(table.ids()) == table.raw


def test_an_edit_renews_little(words):
    table = prefix_bpe.Prefixes(words, b"tokenization" * 5000)
    assert table.replace(30_000, 30_001, b"qq") < 4 * words.longest + 100
    assert table.last == prefix_bpe.Prefixes(words, table.raw).last
    text = prefix_bpe.Encoded(words, "some words, and more of them. " * 2000)
    assert text.replace(20_000, 20_003, "X  y") < 12


def test_texts_are_exact_under_edits(words, library):
    for _ in range(400):
        state = prefix_bpe.Encoded(words, any_text(80))
        for _ in range(5):
            start = random.randrange(len(state.text) + 1)
            end = random.randrange(start, min(len(state.text), start + 9) + 1)
            state.replace(start, end, any_text(9))
            assert state.ids() == library.encode_ordinary(state.text), state.text
        state.append("'s  \n")
        assert state.ids() == library.encode_ordinary(state.text)


def test_tokens_that_merges_never_give_are_only_whole_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}  # abcd has no two parts
    words = prefix_bpe.Vocabulary(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcde", " abcd", "xabcd", "ababcd"):
        assert ids_of(words, text) == library.encode_ordinary(text)


def test_long_texts_come_in_parts(words, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "AT_ONCE", 50)
    text = any_text(4000) + "end"
    assert ids_of(words, text) == library.encode_ordinary(text)


def test_tables_of_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "n'a"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    want = sorted((str(d), len(ids := library.encode_ordinary(t or "")), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in prefix_bpe.digest(docs).collect()) == want
    back = prefix_bpe.decoded(prefix_bpe.encoded(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.content)) for r in back) == sorted((str(d), (t or "").encode()) for d, t in rows)
    assert prefix_bpe.digest(docs.limit(0)).collect() == [] and prefix_bpe.encoded(docs.limit(0)).count() == 0
    edits = spark.createDataFrame([(1, "abc def", [(3, 4, "  "), (0, 1, "")]), (2, "x", None), (3, None, [(0, 0, "y'all")])], "doc_id long, text string, edits array<struct<start: int, end: int, text: string>>")
    got = {r.doc_id: (r.text, r.ids) for r in prefix_bpe.edited(edits).collect()}
    assert got == {i: (t, library.encode_ordinary(t)) for i, t in {1: "bc  def", 2: "x", 3: "y'all"}.items()}
