"""The audit of filters against a count by hand, and the matrix against Counters, with odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from earshot.llm import filters

random.seed(3)
SEPARATED = re.compile("[^\x20\x09-\x0d]+")
KIND = "doc_id long, text string, lang string, source string, words int, part string"


def fails(doc_id, text, rows):
    text = text or ""
    words = SEPARATED.findall(text)
    same = [d for d, t, *_ in rows if (t or "") == text and d is not None and doc_id is not None and d < doc_id]
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": bool(same)}


def by_hand(rows, labels):
    out = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(fails(d, t, rows), any(d is not None and x[0] == d and x[1] == 1 for x in labels), any(d is not None and x[0] == d and x[2] == 1 for x in labels)) for d, t, s in rows if (s or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                here = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(x[0][f] for x in gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in mine), sum(x[1] for x in here), sum(x[2] for x in here)]
                gone += here
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def text_of(i):
    words = [random.choice(["a", "Be", "CEE", "x#", "é漢", "q\x1cq", " "]) + (str(random.randrange(400)) if i % 3 else "") for _ in range(random.choice([0, 5, 199, 200, 230]))]
    return "".join(w + random.choice(" \t\n\x0b\x0c\r") for w in words)


@pytest.fixture(scope="module")
def rows():
    out = [(i, text_of(i), random.choice(["s", "t", "", None])) for i in range(60)]
    out += [(i, out[i % 7][1], "s") for i in range(60, 75)] + [(3, out[3][1], "s"), (3, "other", None), (None, out[2][1], "t"), (None, out[2][1], "t"), (80, None, "u"), (81, "", "u"), (-5, out[8][1], None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, "clash") for d, t, s in rows], KIND)


def test_audit_counts_by_hand(spark, rows):
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 70, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for options in ({}, {"shard_bytes": 700, "bucket_words": 50, "hot_words": 10, "hot_shards": 2}):
        got = filters.audit(frame(spark, rows), table, **options)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == by_hand(rows, labels)
    assert filters.audit(frame(spark, []), table).collect() == []
    assert filters.audit(frame(spark, rows[:3]), table.limit(0)).count() == 600 * len({r[2] or "" for r in rows[:3]})


def test_matrix_holds_every_count(spark, rows, monkeypatch):
    monkeypatch.setattr(filters, "STRETCH", 64)
    docs = frame(spark, rows).selectExpr("doc_id", "'p' AS part", "coalesce(text, '') AS text")
    words, matrix = filters.term_matrix(docs, shard_bytes=900, bucket_words=40, hot_words=30, hot_shards=3)
    listed = {r.term: (r.word, r.shards) for r in words.collect()}
    assert sorted(listed) == list(range(len(listed))) and len({w for w, _ in listed.values()}) == len(listed)
    assert max(n for _, n in listed.values()) > 3  # some are hot
    got = []
    for r in matrix.collect():
        for i, d in enumerate(r.docs):
            span = slice(r.indptr[i], r.indptr[i + 1])
            got.append((str(d.doc_id), sorted((listed[t][0], n) for t, n in zip(r.terms[span], r.counts[span]))))
    assert sorted(got) == sorted((str(d), sorted(Counter(SEPARATED.findall(t or "")).items())) for d, t, _ in rows)


def test_hot_words_are_few():
    assert filters.hot_limit(10) == filters.HOT_SHARDS and filters.hot_limit(10**12) * filters.HOT_WORDS == 10**12
