"""Small fixtures of the text operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from earshot.llm import brown, forest, neighbours, tiff

EDGES = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "no id"), (4, "long text " * 3000), (5, "é\t\n ")]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS predicted", "2 AS page", "3 AS block")


def fold(doc, m):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % m


def test_brown_base_score_matches_brute_force(spark, edges):
    rows = EDGES + [(i, f"the cat {i % 7} sat on the mat") for i in range(10, 60)]
    words = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t in rows if fold(d, 7) != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d or -1, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    got = brown.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert brown.scored(edges).count() == len(EDGES)
    assert brown.scored(edges.limit(0)).collect() == []


def test_brown_model_is_a_distribution():
    counts, share = np.random.default_rng(1).integers(0, 9, (brown.ALL, brown.ALL)).astype(float), np.full(brown.ALL, 1 / brown.ALL)
    assert np.allclose((10 ** brown.lift(counts, share) * share).sum(axis=1), 1)


def test_exchange_parts_words_of_different_use():
    pairs = np.zeros((5, 5))
    for a in (0, 1):
        for b in (2, 3):
            pairs[a, b] = pairs[b, a] = 20
    of = brown.exchange(pairs, 4, classes=2)
    assert of[0] == of[1] != of[2] == of[3]


@pytest.mark.parametrize("small", [0, 3, 50])
def test_gains_equal_placement_on_the_table_without_the_word(monkeypatch, small):
    rng = np.random.default_rng(2)
    size, words = 6, 9
    pairs = rng.integers(0, 4, (words, words)).astype(float)
    own = np.array([0, 1, 2, 3, 4, 0, 1, -1, 5])
    onehot = np.array([np.eye(size)[k] if k >= 0 else np.zeros(size) for k in own])
    out, into = (pairs - np.diag(np.diag(pairs))) @ onehot, (pairs - np.diag(np.diag(pairs))).T @ onehot
    both = np.hstack([out, into])
    row, ctx = np.nonzero(both)
    monkeypatch.setattr(brown, "SMALL", small)
    got = brown.gains(brown.Steps(onehot.T @ pairs @ onehot), own, np.diag(pairs), row, ctx, both[row, ctx])
    for w in range(words):
        rest = onehot.copy()
        rest[w] = 0
        assert np.allclose(got[w], brown.placement_gain(rest.T @ pairs @ rest, out[w], into[w], pairs[w, w]))


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_words_that_never_meet_a_frequent_one_are_clustered(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(brown, "FREQUENT", 4)
    monkeypatch.setattr(brown, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(brown, "BUCKET_BYTES", 10 * block_bytes)
    rng = np.random.default_rng(4)
    texts = [" ".join(x for _ in range(8) for x in (f"a{rng.integers(12)}", f"b{rng.integers(12)}")) for _ in range(150)] + ["often than very much"] * 400
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    got = {bytes(r["word"]).decode(): r["class"] for r in brown.classed_vocabulary(docs, 3).collect()}
    left, right = ({got[f"{x}{i}"] for i in range(12)} for x in "ab")
    assert len(got) == 29 and got[" "] == 3 and len(left) == len(right) == 1 and left != right


def test_tokens_are_words_and_ends():
    rng = random.Random(2)
    signs = [chr(i) for i in range(48)] + list("aZé\u00a0\u0085\u2003\U0001f600İ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, " \t"]
    x, sizes, words = brown.tokens_of(texts)
    want = [[*(t or "").encode().lower().split(), brown.STOP] for t in texts]
    assert [words[i] for i in x] == [w for ws in want for w in ws] and sizes.tolist() == list(map(len, want))
    assert len(set(words)) == len(words)


def test_packed_numbers_come_back():
    for x in (np.zeros(0, np.int64), np.array([0, -1, 255, 256, 1 << 40, -(1 << 62)])):
        assert (brown.unpack(brown.pack(x)) == x).all()


def test_classes_grow_with_the_vocabulary():
    assert brown.classes_for(0) == brown.CLASSES < brown.classes_for(10**6) < brown.classes_for(10**8)


def test_votes_separate_and_take_any_text(spark, edges):
    docs = [(i, "Plain words in a calm line. " * 8 if i % 2 else "W%% O## X!! | " * 12) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = neighbours.scored(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert all(r.predicted == r.doc_id % 2 and r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in neighbours.scored(edges, labels).collect())
    assert {r.score for r in neighbours.scored(edges, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 5, (70, 50)).astype(np.uint8), rng.integers(0, 60000, (3, 9)).astype(np.uint16)]
    back = list(tiff.pages(tiff.encode(images, compression, predictor, tile, strip_rows=16, order=order)))
    assert len(back) == 2 and all((a[:, :, 0] == b).all() for a, b in zip(back, images))


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_tiff_samples_of_few_bits(bits, tile):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (37, 29)).astype(np.uint8)
    back = next(tiff.pages(tiff.encode([image], tiff.PACKBITS, 1, tile, strip_rows=10, bits=bits)))
    assert (back[:, :, 0] == image).all()


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_tiff_floating_point_predictor(kind, order, tile):
    image = np.random.default_rng(1).normal(size=(21, 18)).astype(kind)
    back = next(tiff.pages(tiff.encode([image], tiff.DEFLATE, 3, tile, strip_rows=8, order=order)))
    assert (np.ascontiguousarray(back[:, :, 0]).view(kind) == image).all()


def test_tiff_walk_goes_on_after_a_bad_page(spark):
    image = np.arange(64 * 8, dtype=np.uint8).reshape(8, 64)
    data = bytearray(tiff.encode([image, image, image]))
    second = list(tiff.directories(bytes(data)))[1]
    data[second[tiff.STRIP_OFFSETS][0]] ^= 0xFF  # no deflate header
    rows = tiff.page_table(spark.createDataFrame([(bytes(data), 1)], "media binary, page int")).orderBy("page").collect()
    assert [(r.page, r.error is None) for r in rows] == [(0, True), (1, False), (2, True)] and rows[2].payload == image.tobytes()


def test_tiff_digest(spark, edges):
    got = tiff.digest(edges).collect()
    assert len(got) == len(EDGES)
    for r in got:
        payloads = [tiff.text_payload(t) for d, t in EDGES if d == r.doc_id]
        n, payload = payloads[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tiff.digest(edges.limit(0)).collect() == []


def test_broken_files_give_errors(spark):
    rows = tiff.page_table(spark.createDataFrame([(1, b"junk"), (2, None)], "id int, media binary")).collect()
    assert all(r.error and r.page is None for r in rows)


def test_forest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16))
    vectors = [base[i % 20] + rng.normal(size=16) * 0.02 for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[1][1], rows[1][2]), (204, [None] * 16, 1)]
    got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    for i, v, y in good:
        links = [j for j, w, z in good if z == y and j != i and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        assert got[i].n_links == len(links)
        assert got[i].component_id <= min([i, *links])
    assert all(got[i].kept and got[i].n_links == 0 for i in (200, 201, 202, 204))


@pytest.mark.parametrize("sample", [60_000, 150])
def test_forest_finds_links_across_many_leaves(spark, monkeypatch, sample):
    monkeypatch.setattr(forest, "SAMPLE", sample)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 24))
    vectors = [base[i % 300] + rng.normal(size=24) * 0.03 for i in range(900)]
    rows = [(i, [float(x) for x in v], "ab"[i % 2] if i < 880 else None, i) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cid long").selectExpr("*", "1 AS tree", "2 AS n", "3 AS kept")
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(frame, leaf_rows=40).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    same = np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    near = (unit @ unit.T >= 0.98) & same & ~np.eye(900, dtype=bool)
    want = near.sum(axis=1)
    assert want.sum() > 500 and all(got[i] <= want[i] for i in range(900))
    assert sum(got.values()) >= 0.97 * want.sum()
    assert forest.near_duplicates(frame.limit(0)).collect() == []


def test_votes_equal_brute_force():
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "Gamma", "x1", "%%", "line\n", "é"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(90)] + ["", "a", "word " * 5000]
    model = neighbours.Voters([(t, i % 2) for i, t in enumerate(texts[:60])], rank=12)
    latent = model.latent(texts)
    cosines = np.round(latent @ model.vectors.T, 12)
    assert np.allclose(np.linalg.norm(latent, axis=1), 1)
    found = model.scores(texts)
    for i in range(len(texts)):
        near = np.argsort(-cosines[i], kind="stable")
        edge = cosines[i][near[neighbours.NEIGHBOURS - 1]]
        if (cosines[i] == edge).sum() > 1:
            continue  # a tie at the edge may go either way
        near = near[: neighbours.NEIGHBOURS]
        votes = np.maximum(cosines[i][near], 1e-3) ** neighbours.POWER
        assert abs(found[i] - (votes * model.labels[near]).sum() / votes.sum()) < 1e-8
    assert np.array_equal(model.scores(texts[::-1])[::-1], found)
    assert len(set(model.scores(["same text"] * 300).tolist())) == 1
