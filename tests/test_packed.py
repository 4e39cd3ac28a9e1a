"""Packed documents by very small ranges against json.loads of the whole."""

import json
import random

import pytest

from earshot.sources import packed

random.seed(4)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(depth=0):
    kinds = [lambda: random.randrange(99), lambda: random.choice(['a}"{', "}}", "\\", '\\"', "[{", "é漢", '"summaries":[']), lambda: None]
    if depth < 3:
        kinds += [lambda: {random.choice("ab}{"): value(depth + 1) for _ in range(random.randrange(3))}, lambda: [value(depth + 1) for _ in range(random.randrange(3))], lambda: {"summaries": [value(depth + 1)]}]
    return random.choice(kinds)()


def entry(clip):
    return {"clip_id": clip, "v": value(), "w": {"x": value()}} if random.random() < 0.9 else random.choice([7, None, [1, {}], {"none": value()}])


def document(i):
    clips = [f"c{random.randrange(40)}" for _ in range(25)]
    if i % 3 == 0:
        return [entry(c) for c in clips]
    if i % 3 == 1:
        return {"version": {"summaries": [1]}, "summaries": [entry(c) for c in clips], "more": [{"clip_id": "no"}], "clip": {"clip_id": "neither"}}
    return {c: entry(c) for c in clips} | {"n": 3, "list": [{"clip_id": "no"}]}


def index_of(docs):
    out = {}
    for _, doc in sorted(docs.items()):
        listed = doc.get("summaries") if isinstance(doc, dict) and isinstance(doc.get("summaries"), list) else doc if isinstance(doc, list) else None
        for clip, e in ((None, e) for e in listed) if listed is not None else doc.items():
            clip = clip if listed is None else e.get("clip_id") if isinstance(e, dict) else None
            if isinstance(e, dict) and clip:
                out[clip] = e
    return out


def test_ranges_give_the_index_of_whole_documents(spark, tmp_path, small_ranges):
    docs = {f"d{i:02d}.json": document(i) for i in range(9)}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=random.random() < 0.5, indent=random.choice([None, 2])) + random.choice(["", "\n"]), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    assert packed.segments_of(spark, str(tmp_path)).select("file", "start").distinct().count() > 100
    got = {r.clip_id: json.loads(str(r.s)) for r in packed.packed_index(spark, str(tmp_path)).selectExpr("clip_id", "to_json(summary) AS s").collect()}
    assert got == index_of(docs)


def test_files_of_one_range_skip_the_first_pass(spark, tmp_path, monkeypatch):
    docs = {f"d{i:02d}.json": document(i) for i in range(6)}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    seen, effects = [], packed.effects
    monkeypatch.setattr(packed, "effects", lambda s: seen.append(s.count()) or effects(s))
    got = {r.clip_id: json.loads(str(r.s)) for r in packed.packed_index(spark, str(tmp_path)).selectExpr("clip_id", "to_json(summary) AS s").collect()}
    assert seen == [0] and got == index_of(docs)


def test_one_entry_over_many_ranges(spark, tmp_path, small_ranges):
    doc = {"a": {"long": ["}" * 30] * 40, "deep": [[{"x": {"y": i}} for i in range(60)]]}, "b": {"c": 1}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = {r.key: json.loads(r.text) for r in packed.packed_entries(spark, str(tmp_path)).collect()}
    assert got == doc
    (tmp_path / "none").mkdir()
    assert packed.packed_index(spark, str(tmp_path / "none")).collect() == []
