"""Hard negatives against all scores in whole numbers, and remainders against plain products."""

import math
import random

import numpy as np
import pytest

from earshot.llm import negatives

random.seed(11)
KIND = "vec_id long, embedding array<float>, label int, score string, slot int"


def by_hand(rows):
    kept = []
    for i, (v, e, label) in enumerate(rows):
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, v, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, v, label, q in kept:
        if v % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, w)), u, j, m) for j, u, m, w in kept if j != i]
        for p, positive, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            fits = [s for s in sorted(scored) if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(v, positive, k, s[1], -p, -s[0]) for k, s in enumerate(fits[:5], 1)]
    return sorted(out)


def near(center, spread):
    return [c + random.gauss(0, spread) for c in center]


@pytest.fixture(scope="module")
def rows():
    centers = [near([0] * 6, 0.6) for _ in range(3)]
    out = [(i, near(random.choice(centers), 0.1), random.randrange(3)) for i in range(600)]
    out += [(i, out[0][1], i % 4) for i in range(600, 640)]  # ties
    out += [(100, out[100][1], 1), (100, out[100][1], 1), (150, out[3][1], 9)]
    out += [(None, out[0][1], 1), (700, None, 1), (701, out[0][1], None), (702, [0.5, None], 1), (703, [math.nan] * 6, 1), (704, [math.inf], 1), (800, [], 0), (801, [0.1], 1), (900, [3.0, -2.0], 1), (1000, [-1.0] * 8, 55), (1100, [4.0] * 6, 77)]
    return out


def test_result_is_that_of_all_scores(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    want = by_hand(rows)
    assert len(want) > 30
    for block in (2048, 3):
        assert sorted(map(tuple, negatives.hard_negatives(table, anchor_block=block).collect())) == want
    assert negatives.hard_negatives(table.limit(0)).collect() == []
    assert negatives.hard_negatives(table.filter("vec_id = 5")).collect() == []


def test_small_parts_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 7)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND).repartition(9)
    assert sorted(map(tuple, negatives.hard_negatives(table).collect())) == by_hand(rows)


@pytest.mark.parametrize("size, width", [(3, 5), (300, 64), (20_000, 1500), (600_000_000, 3)])
def test_remainders_give_exact_products(size, width):
    draw = np.random.default_rng(1)
    a, b = (draw.integers(-size, size + 1, (20, width)).astype(float) for _ in "ab")
    a[0], b[0], b[1] = size, size, -size
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    primes = negatives.primes_for(width * size * size)
    got = negatives.remaindered([negatives.products(negatives.residues(a, p), negatives.residues(b, p), p) for p in primes], primes)
    assert got.tolist() == want


def test_scores_beyond_a_long_are_an_error(spark):
    table = spark.createDataFrame([(0, [1e30], 1, "", 1)], KIND)
    with pytest.raises(ValueError):
        negatives.hard_negatives(table)
