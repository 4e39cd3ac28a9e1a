"""Key filters, record graphs and keyed streams against brute force."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from earshot.operators import checks, keyfilters, lineage
from earshot.streaming import repeats


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_filtered_orphans_equal_the_plain_join(spark, kind):
    child = spark.range(20_000).select(F.col("id").alias("row"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).cast(kind).alias("key"), F.lit("x").alias("id"))
    parent = spark.range(300).select((F.col("id") * 2).cast(kind).alias("p")).union(spark.sql(f"SELECT cast(NULL AS {kind})"))
    want = sorted(r.row for r in checks.orphans(child, parent, "key", "p").collect())
    got = keyfilters.filtered_orphans(child, parent, "key", "p")
    assert got.columns == child.columns and sorted(r.row for r in got.collect()) == want
    assert sorted(r.row for r in keyfilters.filtered_orphans(child, parent, "key", "p", most_bytes=0).collect()) == want
    assert keyfilters.filtered_orphans(child, parent.limit(0), "key", "p").count() == child.filter("key IS NOT NULL").count()
    assert keyfilters.filtered_orphans(child.limit(0), parent, "key", "p").collect() == []


def test_keys_of_other_types_are_joined_plainly(spark):
    child, parent = spark.range(10).selectExpr("id AS key"), spark.range(5).selectExpr("cast(id AS int) AS p")
    assert sorted(r.key for r in keyfilters.filtered_orphans(child, parent, "key", "p").collect()) == [5, 6, 7, 8, 9]


def test_a_filter_knows_its_keys_and_few_others(spark):
    rows = 3
    known = keyfilters.key_filter(spark.range(0, 6_000, 1).toDF("k"), "k", rows)
    assert sorted((r["_row"], len(r["_words"])) for r in known.collect()) == [(i, keyfilters.WORDS) for i in range(rows)]
    row, word, bits = keyfilters.places(F.col("k"), rows)
    seen = spark.range(60_000).toDF("k").withColumns({"_row": row, "w": word, "b": bits}).join(known, "_row").filter("get(_words, w) & b = b")
    counts = Counter(r.k < 6_000 for r in seen.select("k").collect())
    assert counts[True] == 6_000 and counts[False] < 0.03 * 54_000


def test_nodes_merge_by_id(spark):
    rows = [("a", "b"), ("a", "c"), ("b", "a"), (None, "c"), ("d", None), ("", "c")]
    declared = lineage.declared_nodes(spark.createDataFrame(rows, "x string, y string"), [("X", "x"), ("Y", "y")])
    assert sorted(map(tuple, lineage.merged_nodes(declared).select("id", "type", "n_types", "n").collect())) == [("", "X", 1, 1), ("a", "X", 2, 3), ("b", "X", 2, 2), ("c", "Y", 1, 3), ("d", "X", 1, 1)]
    assert sorted(map(tuple, lineage.conflicts(declared).select("id", "type", "kept", "n").collect())) == [("a", "X", True, 2), ("a", "Y", False, 1), ("b", "X", True, 1), ("b", "Y", False, 1)]
    assert lineage.merged_nodes(declared.limit(0)).collect() == []


def reached(edges):
    out = {}
    for start in {a for a, _ in edges}:
        level, steps, seen = {start}, 0, {}
        while level:
            steps += 1
            level = {b for a, b in edges if a in level} - set(seen)
            seen |= dict.fromkeys(level, steps)
        out |= {(start, b): n for b, n in seen.items()}
    return out


def test_ancestors_with_cycles_and_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 137)] + [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)] + [(50, 50), (60, 61), (61, 60)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (4, None)], "child long, parent long")
    got = {(r.child, r.ancestor): r.steps for r in lineage.ancestors(df).collect()}
    assert got == reached(edges)
    assert lineage.ancestors(df.limit(0)).collect() == []


def run_batches(spark, batches, forget=None):
    source, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for batch in batches:  # each start sees one more file, and goes on where the last one ended
        spark.createDataFrame(batch, "row_key long, id string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("row_key long, id string, at timestamp").parquet(source)
        repeats.repeats_stream(stream, f"{out}/f", f"{out}/s", f"{out}/c", forget).awaitTermination()
    return sorted((r.row_key, r.id) for r in spark.read.schema(repeats.FINDING).parquet(f"{out}/f").collect())


def test_stream_repeats_equal_a_batch(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(repeats, "WHOLE_EVERY", 3)
    rng, now = random.Random(8), datetime(2024, 1, 1)
    keys = rng.sample(range(10_000), 400)
    rows = [(k, rng.choice(["", None, "hot", "hot", *"abcdefgh", str(k)]), now) for k in keys]
    first = {}
    for k, i, _ in rows:
        first[i] = min(first.get(i, k), k)
    want = sorted((k, i) for k, i, _ in rows if i and k > first[i])
    assert run_batches(spark, [rows[n::5] for n in range(5)]) == want and len(want) > 100


def test_ids_are_forgotten_at_a_whole_state(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(repeats, "WHOLE_EVERY", 2)
    day = lambda n: datetime(2024, 1, n)
    batches = [[(1, "a", day(1)), (2, "b", day(9))], [(3, "a", day(2))], [(4, "b", day(20))], [(5, "a", day(20)), (6, "b", day(20))]]
    assert run_batches(spark, batches, "15 days") == [(3, "a"), (4, "b"), (6, "b")]
    assert run_batches(spark, batches) == [(3, "a"), (4, "b"), (5, "a"), (6, "b")]
