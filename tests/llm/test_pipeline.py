"""Stages of the pipeline and the whole against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from earshot.llm import common, mixing, packing, simhash, toxicity
from tests.llm.test_pii import base_spans
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tests.llm.test_toxicity import planted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_mix(rows, epochs=3, weights=(5, 2, 1)):
    """How often weighted fair queueing takes each row (doc_id, text, source): finish times, sorted, up to the budget."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (*_, x) in zip(size, rows) if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, free = {}, float(sum(size)), list(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > epochs * total[s]]
        for s in full or free:
            target[s] = float(epochs * total[s]) if full else weight[s] * level
            free = [x for x in free if x != s]
            left -= target[s]
    line = []
    for s in sources:
        own = sorted((hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:0".encode()).hexdigest(), rows[i][0] or -1, size[i], i) for i in range(len(rows)) if rows[i][2] == s)
        for epoch in range(epochs):
            cum = 0
            for u, doc, n, i in own:
                cum += n
                finish = (epoch * total[s] + cum) / target[s] if target[s] > 0 else 0.0
                line.append((finish, s is None, s or "", u, doc, n, i))
    taken, used = [0] * len(rows), 0
    for *_, n, i in sorted(line):
        used += n
        if used > sum(size):
            break
        taken[i] += 1
    return taken, target


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None) for i, (t, _) in enumerate(planted(420, 11))]
    rows += [(1000 + i, rows[i * 5 + 1][1], "en", "a") for i in range(30)]
    rows += [(2000 + i, f"write to user{i}@example.org or {i}.1.2.3 or +49 30 1234567{i % 10}", "de", "b") for i in range(20)]
    rows += [(3000, None, None, None), (3001, "", "en", "c"), (3002, "calm " * 9000, "en", "c")]
    labels = [(i, int(i % 3 == 0)) for i in range(420)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels = corpus
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", mixing.F.lit(1)).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_turn(spark, corpus, folder):
    rows, labels = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    docs = common.saved(stages["toxicity"](spark, docs, folder))
    learned = [(t, labels[i][1]) for i, t, *_ in rows[:420] if zlib.crc32(str(i).encode()) % 5]
    scores = toxicity.Scorer(toxicity.train(learned)).scores([r[1] for r in rows])
    kept = [r for r, s in zip(rows, scores) if s < 0.5]
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == [r[0] for r in kept]
    bad = {r[0] for r in rows[:420] if r[0] % 3 == 0}
    assert len(bad & {r[0] for r in kept}) <= 0.05 * len(bad) and len([r for r in rows if r[0] not in bad and r not in kept]) <= 0.05 * len(rows)

    docs = common.saved(stages["simhash"](spark, docs, folder))
    roots = brute_groups([brute_fingerprint(r[1]) for r in kept])
    first = {}
    for r, root in zip(kept, roots):
        first[root] = min(first.get(root, r), r, key=lambda x: x[0])
    kept = sorted(first.values(), key=lambda r: r[0])
    assert docs.columns == columns and [r.doc_id for r in docs.orderBy("doc_id").collect()] == [r[0] for r in kept]

    docs = common.saved(stages["pii"](spark, docs, folder))
    clean = []
    for i, text, lang, source in kept:
        out, end = "", 0
        for s, kind, e in base_spans(text or ""):
            out, end = out + text[end:s] + f"[{kind.upper()}]", e
        clean.append((i, None if text is None else out + text[end:], lang, source))
    assert docs.columns == columns and [tuple(r)[:4] for r in docs.orderBy("doc_id").collect()] == clean
    assert any("[EMAIL]" in (r[1] or "") for r in clean) and all(r.n_chars == len(r.text) for r in docs.filter("text IS NOT NULL").collect())

    docs = common.saved(stages["mixing"](spark, docs, folder))
    taken, target = brute_mix([(i, t, s) for i, t, _, s in clean])
    want = sorted(i for (i, *_), n in zip(clean, taken) for _ in range(n))
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == want

    pieces = stages["packing"](spark, docs, folder).collect()
    mixed = [r.text for r in docs.collect()]
    encode = packing.encoder(None).encode
    lengths = [len(encode(t or "")) + 1 for t in mixed]
    assert sum(p.length for p in pieces) == sum(lengths)
    cut = [n for total in lengths for _, n in packing.cut_points(total, packing.SEQUENCE)]
    assert sorted(p.length for p in pieces) == sorted(cut)
    bound = packing.lower_bound(np.bincount(cut, minlength=packing.SEQUENCE + 1), packing.SEQUENCE)
    assert len({p.sequence_id for p in pieces}) == bound

    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda p: (p.doc_id or -1, p.piece, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_mix_counts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "ü", None][int(rng.integers(0, 4)) if i % 5 else 0]) for i in range(200)]
    got = {r["doc_id"]: r for r in mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    taken, target = brute_mix(rows)
    assert [got[i]["times"] for i, *_ in rows] == taken
    assert all(abs(got[i]["target"] - target[s]) < 1e-6 for i, _, s in rows)


def test_rows_of_one_id_and_text_are_spread(spark):
    """Null ids, one text in most rows, empty texts: every range of the queues gets its share, sums stay right."""
    rows = [(None, "a b c", "s")] * 3000 + [(None, None, "s")] * 500 + [(7, "x " * (i % 5), "t") for i in range(300)] + [(i, "y y", None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sized = mixing.sized_rows(docs.select(mixing.F.monotonically_increasing_id().alias("row"), "*"), 0)
    dealt = sized.repartitionByRange(4, "source", *mixing.ORDER).groupBy(mixing.F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.4 * len(rows)
    _, target = brute_mix(rows)
    taken, _ = brute_mix(rows)
    by_key: dict = {}
    for r, n in zip(rows, taken):
        key = (str(r[0]), r[2], len((r[1] or "").split()))
        by_key[key] = by_key.get(key, 0) + n
    got: dict = {}
    for r in mixing.mix_counts(docs).collect():
        key = (str(r.doc_id), r.source, r.size)
        got[key] = got.get(key, 0) + r.times
        assert abs(r.target - target[r.source]) < 1e-6
    assert {k: n for k, n in got.items() if k[2]} == {k: n for k, n in by_key.items() if k[2]}
    assert mixing.mix(docs).filter("text IS NOT NULL").count() == sum(n for (*_, n) in [(k, v) for k, v in got.items() if k != ("None", "s", 0)])


def test_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    named = docs.limit(40).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS _kept", "4 AS pii", "5 AS size", "6 AS part", "7 AS h", "8 AS times")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, named, folder).count() > 0, name
