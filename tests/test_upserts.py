"""Upserts by folder: what stays untouched, what a rerun gives, odd rows."""

import os

import pytest

from earshot.operators import upserts

KIND = "dataset_id string, feature_id string, clip_id string, feature_type string"


def files_in(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_untouched_folders_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "features")
    old = [(d, f"{d}{i}", f"c{i}", "emb" if i % 2 else "other") for d in ("a", "b") for i in range(60)] + [(None, "n", None, "emb"), ("a", "e", "", "emb")]
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    upserts.write_table(frame(old), path, 8)
    before = files_in(path)
    new = [("a", "new1", "c1", "emb"), ("a", "new2", "c1", "emb"), ("a", "fresh", "c999", "emb")]
    touched = upserts.upsert_clips(path, frame(new), KIND, "emb", 8)
    after = files_in(path)
    folder = lambda f: tuple(os.path.relpath(f, path).split("/")[:2])
    changed = {folder(f) for f in before ^ after}
    assert changed == {(f"dataset_id={d}", f"bucket={b}") for d, b in touched} and len(touched) <= 2 and len(before & after) > 8
    want = sorted([(d, *r) for d, *r in old if (d, r[0]) != ("a", "a1")] + new, key=str)
    read = lambda: sorted((tuple(r)[:4] for r in upserts.read_table(spark, path, KIND).select(*[c.split()[0] for c in KIND.split(", ")]).collect()), key=str)
    assert read() == want
    upserts.upsert_clips(path, frame(new), KIND, "emb", 8)
    assert read() == want and upserts.upsert_clips(path, frame([]), KIND, "emb", 8) == []
    assert upserts.upsert_clips(path, frame([("", "m", "c7", "emb"), (None, "m2", "c7", "emb")]), KIND, "emb", 8)[0][0] is None
    upserts.upsert_clips(path, frame([("", "last", "c7", "emb")]), KIND, "emb", 8)
    assert [r[1] for r in read() if r[0] is None] == ["last", "n"] and [r for r in read() if r[0]] == [r for r in want if r[0]]
    with pytest.raises(ValueError):
        upserts.upsert_clips(path, frame([("a", "x", None, "emb")]), KIND, "emb", 8)
