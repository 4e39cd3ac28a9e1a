"""Suffix deduplication against brute force over all strings of 50 bytes."""

import hashlib
import random

import numpy as np

from earshot.llm import suffixes

N = suffixes.LENGTH


def brute(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - N + 1 if doc is not None else 0):
            s = raw[i : i + N]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - N + 1 if doc is not None else 0):
            if first[raw[i : i + N]] < doc:
                gone[i : i + N] = b"\1" * N
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(60) for _ in range(6)]
    rows = [(i * 3, prose(30)) for i in range(10)]
    for i in range(60):
        a = rng.choice(base)
        cut = rng.randint(0, 100)
        piece = a[cut : cut + rng.randint(30, 250)]
        if i % 3 == 0:
            at = rng.randint(0, len(piece) - 1)
            piece = piece[:at] + "#" + piece[at + 1 :]
        rows.append((1000 - 7 * i, prose(rng.randint(0, 15)) + piece + prose(rng.randint(0, 15))))
    rows += [(1, None), (2, ""), (4, "x" * 500), (5, "x" * 49), (7, "y" + "x" * 60 + "z"), (None, base[0]), (2000, base[0]), (2001, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "2 AS spans")
    got = sorted((tuple(r) for r in suffixes.digest(df).collect()), key=repr)
    assert got == brute(rows)
    assert any(r[2] for r in got)


def test_empty_table(spark):
    assert suffixes.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_blocks_and_buckets_agree(spark):
    rows = [(i, "the same passage of more than fifty bytes in every text " + str(i)) for i in range(40)]
    rows += [(90 + i % 3, f"{i} texts of one id {i}, and what they share: more than fifty bytes of one passage") for i in range(9)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"bucket_rows": 3, "block_bytes": 300}, {"bucket_rows": 10**9}):
        assert sorted((tuple(r) for r in suffixes.digest(df, **options).collect()), key=repr) == brute(rows)


def test_pieces_of_long_texts_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(97, 100, 5000).astype(np.uint8)
    sizes = np.array([0, 1200, 49, 50, 3701])
    whole = suffixes.anchors(x, sizes)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    assert all((a == b).all() for a, b in zip(whole, suffixes.anchors(x, sizes)))
    assert (whole[2] - whole[1] + 1).sum() == sum(max(n - N + 1, 0) for n in sizes)


def test_rows_alike_in_id_and_text_share_their_spans(spark):
    text = "a passage that several documents hold, word by word and byte by byte"
    rows = [(5, text), (5, text), (5, text + " and more"), (6, text), (6, text), (None, text), (None, text)]
    got = sorted((tuple(r) for r in suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def contexts(documents, each, seed):
    """Documents in which one lead, whose hash is lower than most, stands in different contexts; some recur."""
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    tries = letters[rng.integers(0, 27, 100_000)]
    place, begin, end = suffixes.anchors(tries, np.array([len(tries)]))
    best = place[np.argmax(end - begin)]  # it owns as many suffixes as one can
    lead = bytes(tries[best : best + suffixes.LEAD]).decode()
    side = lambda: bytes(letters[rng.integers(0, 27, 40)]).decode()
    known = [side() + lead + side() for _ in range(max(documents // 3, 1))]
    rows = []
    for i in range(documents):
        parts = [side() + lead + side() for _ in range(each)]
        parts[0] = known[rng.integers(0, len(known))]
        cut = known[rng.integers(0, len(known))]
        parts[1] = side()[:20] + cut[rng.integers(5, 30) : rng.integers(66, 90)] + side()[:20]
        rows.append((int(rng.integers(0, 10 * documents)), "".join(parts)))
    return rows


def test_hot_leads_are_parted_by_suffix(spark):
    rows = contexts(150, 12, 5) + [(3, None), (None, "x" * 80), (8, " " * 300), (9, " " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    for options in ({"hot_anchors": 0}, {"hot_anchors": 0, "bucket_rows": 200, "block_bytes": 20_000}, {"hot_anchors": 30, "bucket_rows": 500, "block_bytes": 50_000}):
        assert sorted((tuple(r) for r in suffixes.digest(df, **options).collect()), key=repr) == want


def test_a_lead_with_many_contexts_agrees_with_the_plain_way(spark):
    df = spark.createDataFrame(contexts(1000, 100, 6), "doc_id long, text string").repartition(4).cache()
    rows = lambda **options: sorted(tuple(r) for r in suffixes.digest(df, block_bytes=1 << 20, **options).collect())
    assert rows(hot_anchors=20_000, bucket_rows=20_000) == rows(hot_anchors=10**9)
