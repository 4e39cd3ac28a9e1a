"""The toxicity network: grams in parts, one label, empty texts, held-out accuracy on planted words."""

import numpy as np

from earshot.llm import toxicity


def planted(n: int, seed: int) -> list[tuple[str, int]]:
    rng = np.random.default_rng(seed)
    calm, foul = [f"plain{i}" for i in range(200)], ["vileword", "foulterm", "nastything"]
    rows = []
    for i in range(n):
        words = list(rng.choice(calm, rng.integers(1, 90)))
        if i % 3 == 0:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(foul)))
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_grams_in_parts_equal_the_whole(monkeypatch):
    net, known = toxicity.Network(), toxicity.Network.grams(["a", "", "naïve", "x" * 5000, "word", "words", "..."])
    whole = net.word_inputs(known)
    monkeypatch.setattr(toxicity, "CHUNK_GRAMS", 2)
    assert np.array_equal(net.word_inputs(known), whole)


def test_one_label_or_none_gives_its_share():
    assert toxicity.train([]) == 0.0
    assert toxicity.train([("a b", 1), ("c", 1)]) == 1.0


def test_held_out_texts():
    scorer = toxicity.Scorer(toxicity.train(planted(900, 1)))
    rows = planted(300, 2)
    found = scorer.scores([t for t, _ in rows]) >= 0.5
    assert (found == np.array([y for _, y in rows])).mean() > 0.95
    empty = scorer.scores([None, "", "  "])
    assert len(set(empty.tolist())) == 1 and 0 <= empty[0] <= 1


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["bad", "good", "fine.", "naïve", "a"]
    known = toxicity.Network.grams(words)
    at = rng.integers(0, len(words) + 1, (toxicity.WINDOW, 6))
    at[0] = 1
    y = np.array([1, 0, 1, 1, 0, 0], np.float64)

    def loss() -> float:
        z = net.logits(net.projected(net.word_inputs(known)).astype(np.float64), at).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradient(known, at, y)
    for name in ("out", "bias", "pick", "att", "in_f", "in_b", "own_f", "own_b", "add_f", "add_b", "word", "char"):
        flat, slope = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            old, step = flat[i], 2e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - slope[i]) < 0.03 * abs(slope[i]) + 2e-4, name


def test_tables_of_every_kind(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(planted(240, 4))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "vileword"), (500, None), (501, ""), (0, "again 0")], "doc_id long, text string").selectExpr("*", "7 AS score", "'p' AS predicted", "1 AS held_out")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).collect() == []
    assert set(toxicity.scored_rows(docs, labels).columns) == set(docs.columns)
