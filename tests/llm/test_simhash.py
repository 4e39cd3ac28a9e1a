"""Fingerprints and their groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from earshot.llm import mixing, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit, n in enumerate(counts) if 2 * n > len(shingles))


def brute_groups(fps):
    """The smallest index that links reach, for each of some fingerprints."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "A", "\x0b", "x y"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(n) for n in (1, 2, 3, 4, 30, 80, 200, 400)]
    out = [(i * 7 % 61, rng.choice(base) + (" " + text(1) if i % 3 == 0 else "")) for i in range(61)]
    return out + [(100, None), (99, ""), (98, " \t"), (101, "w1"), (None, base[3]), (None, "alone null " * 9)]


def test_groups_match_brute_force(spark, rows):
    got = simhash.digest(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS group", "3 AS h")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_groups(fps)
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    want = [(doc, f"{fp:016x}", least.get(r)) for (doc, _), fp, r in zip(rows, fps, roots)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({w[2] for w in want}) < len(rows) - 20
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("pairwise", [4, 64])
@pytest.mark.parametrize("spread", [16, 32])
def test_links_in_long_lists_match_brute_force(monkeypatch, pairwise, spread):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(pairwise + spread)
    base = rng.integers(0, 1 << spread, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << i) for i in rng.integers(0, spread, 6).tolist()), np.arange(200, dtype=np.uint64)]))
    rng.shuffle(fps)
    lists = np.repeat([0, 1, 2], [len(fps) - 30, 20, 10])
    got = {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, simhash.linked(fps, lists)))}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if lists[i] == lists[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_one_row_of_each_group_survives(spark):
    text = "the same words in every row of this group"
    other = "an unrelated text that shares one id with the group, and nothing else at all"
    rows = [(5, text), (3, text), (3, text), (3, other), (None, text), (None, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _kept", "2 AS row", "3 AS _d", "4 AS h", "5 AS `a.b`")
    got = simhash.survivors(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("3", text), ("3", other), ("None", text), ("None", "None"), ("7", "None")])
    assert simhash.survivors(docs.limit(0)).collect() == []


def test_mixes_repeat_and_clash(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f", "x"), (2, "one", None), (None, None, None), (None, "", "y"), (3, "long " * 50, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _id", "2 AS _words", "3 AS _copy", "4 AS size")
    first, again = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert first == again and mixing.mix(docs).columns == docs.columns
    counts = mixing.mix_counts(docs).collect()
    assert len(counts) == len(rows) and sum(r["times"] for r in counts) == len(first)
    assert mixing.mix(docs.limit(0)).collect() == []
