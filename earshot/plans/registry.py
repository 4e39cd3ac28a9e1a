"""Registered queries of the survey operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import scores
from earshot.functions.scores import COS45, ITEMS, SCALE
from earshot.operators import aggregates, checks, numbering
from earshot.plans.base import query
from earshot.sources import surveys
from earshot.sources.surveys import FRAMES_SQL, PARTICIPANTS_SQL, PLACES_SQL, STIMULUS_SQL, table

P_SQL = f"((pleasant - annoying) + {COS45}::DOUBLE * ((calm - chaotic) + (vibrant - monotonous))) / {SCALE}::DOUBLE"
E_SQL = f"((eventful - uneventful) + {COS45}::DOUBLE * ((chaotic - calm) + (vibrant - monotonous))) / {SCALE}::DOUBLE"


def even(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE"


COORDINATES = f"{even(P_SQL, 6)} AS iso_pleasant, {even(E_SQL, 6)} AS iso_eventful"


@query(f"WITH {STIMULUS_SQL} SELECT response_key, line, part_key, fold, {COORDINATES} FROM stimulus WHERE fold BETWEEN -1 AND 7")
def p07_coordinates(spark, sf_dir):
    rows = surveys.stimulus_responses(spark, sf_dir).filter("fold BETWEEN -1 AND 7")
    return aggregates.with_coordinates(rows).select("response_key", "line", "part_key", "fold", "iso_pleasant", "iso_eventful")


def _micro(c: str) -> str:
    return even(f"sum(round_even({c} * 1000000, 0)::BIGINT)::DOUBLE / (count({c}) * 1000000)", 4) + f" AS {c}"


@query(f"WITH {STIMULUS_SQL}, placed AS (SELECT *, {COORDINATES} FROM stimulus WHERE fold BETWEEN -1 AND 7) SELECT soundscape, masker, smr, fold, count(*) AS n, "
       + ", ".join(f"{even(f'avg({i})', 4)} AS mean_{i}" for i in ITEMS) + f", {_micro('iso_pleasant')}, {_micro('iso_eventful')} FROM placed GROUP BY soundscape, masker, smr, fold")
def a02_clip_aggregate(spark, sf_dir):
    rows = surveys.stimulus_responses(spark, sf_dir).filter("fold BETWEEN -1 AND 7")
    return aggregates.clips_of_responses(rows, ["soundscape", "masker", "smr", "fold"])


@query(f"WITH {PLACES_SQL}, m AS (SELECT location, session, grp, count(*) AS n, " + ", ".join(f"{even(f'avg({i})', 3)} AS {i}" for i in ITEMS)
       + f" FROM places WHERE location IS NOT NULL AND session IS NOT NULL AND grp IS NOT NULL GROUP BY ALL) SELECT *, {COORDINATES} FROM m")
def a01_place_clips(spark, sf_dir):
    return aggregates.clips_of_rounded_means(surveys.place_responses(spark, sf_dir), ["location", "session", "grp"])


@query("""WITH r AS (SELECT event_type AS recording, user_id, event_id % 8 AS item, CASE WHEN round_even(value * 100, 0)::BIGINT BETWEEN 0 AND 10000 THEN round_even(value * 100, 0)::BIGINT END AS cents FROM events)
SELECT recording, count(*) AS n, count(DISTINCT user_id) AS participants, count(cents) AS rated, round_even((1 + 4 * sum(cents)::DOUBLE / (10000 * count(cents))) * 1000000, 0) / 1000000 AS mean_likert FROM r GROUP BY recording""")
def a03_recordings(spark, sf_dir):
    """Counts, distinct participants and the mean of in-range ratings on the five-point scale."""
    cents = scores.within(F.rint(F.col("value") * 100).cast("long"), 0, 10000)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording"), "user_id", cents.alias("cents"))
    mean = scores.half_even(1 + 4 * F.sum("cents") / (10000 * F.count("cents")), 6)
    return rows.groupBy("recording").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("participants"), F.count("cents").alias("rated"), mean.alias("mean_likert"))


@query("SELECT p_partkey, 'clip_' || regexp_replace(regexp_replace(p_name || '..' || p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS clip_id FROM part")
def p17_safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scores.safe_id(F.concat("p_name", F.lit(".."), "p_type"), "clip_").alias("clip_id"))


@query(f"WITH {STIMULUS_SQL} SELECT response_key, line, part_key, fold, CASE WHEN fold = -1 THEN 'aux' WHEN fold IN (0, 6, 7) THEN 'test' WHEN fold = part_key % 5 + 1 THEN 'dev' ELSE 'train' END AS split, fold = -1 AS is_common FROM stimulus")
def p21_splits(spark, sf_dir):
    rows = surveys.stimulus_responses(spark, sf_dir)
    return rows.select("response_key", "line", "part_key", "fold", scores.split_of(F.col("fold"), F.col("part_key") % 5 + 1).alias("split"), (F.col("fold") == -1).alias("is_common"))


_DURATION = "CASE p_partkey % 7 WHEN 0 THEN concat(p_size, ' Min each') WHEN 1 THEN concat(p_size, '.5 hours') WHEN 2 THEN concat('about ', p_size, ' s') WHEN 3 THEN 'unknown' WHEN 4 THEN '.5 min' WHEN 5 THEN '1.2.3 s' ELSE '' END"


@query(f"""WITH d AS (SELECT p_partkey, lower({_DURATION}) AS body FROM part)
SELECT p_partkey, try_cast(nullif(regexp_extract(body, '([0-9.]+)', 1), '') AS DOUBLE) * CASE WHEN body LIKE '%hour%' THEN 3600 WHEN body LIKE '%min%' THEN 60 ELSE 1 END AS seconds FROM d""")
def p23_durations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scores.seconds_of(F.expr(_DURATION)).alias("seconds"))


_NAMED = "concat(CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN chr(9) ELSE '  ' END, p_type, CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN '  ' ELSE chr(9) END, p_name, CASE p_partkey % 2 WHEN 0 THEN ' -' ELSE '' END)"


@query(f"""WITH c AS (SELECT p_partkey, trim(regexp_replace(replace(lower({_NAMED}), '-', ' '), '\\s+', ' ', 'g')) AS plain FROM part)
SELECT p_partkey, CASE plain WHEN 'economy small ring' THEN 'ring' ELSE replace(plain, ' ', '_') END AS class_name FROM c""")
def p36_class_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scores.canonical_class(F.expr(_NAMED), {"economy small ring": "ring"}).alias("class_name"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 10 AS a, l_quantity + l_linenumber AS b, (l_suppkey % 4 * 10)::DOUBLE AS fps, l_partkey % 300 AS frames FROM lineitem),
t AS (SELECT *, greatest((a + b) / 2, 0) AS mid FROM s), i AS (SELECT *, CASE WHEN fps <= 0 OR frames <= 0 THEN 0 ELSE least(greatest(round_even(mid * fps, 0)::BIGINT, 0), frames - 1) END::BIGINT AS idx FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN fps <= 0 OR frames <= 0 THEN mid ELSE idx / fps END::DOUBLE AS frame_time, idx AS frame_index FROM i""")
def p39_center_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    time, index = scores.center_frame(F.col("l_quantity") - 10, F.col("l_quantity") + F.col("l_linenumber"), (F.col("l_suppkey") % 4 * 10).cast("double"), F.col("l_partkey") % 300)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", time.alias("frame_time"), index.alias("frame_index"))


@query(f"WITH {STIMULUS_SQL}, {PARTICIPANTS_SQL} SELECT response_key, line, part_key, s.participant, language, age FROM stimulus s LEFT JOIN participants p ON s.participant = p.participant AND p.age < 60")
def j01_demographics(spark, sf_dir):
    people = surveys.participants(spark, sf_dir).filter("age < 60")
    return surveys.stimulus_responses(spark, sf_dir).join(people, "participant", "left").select("response_key", "line", "part_key", "participant", "language", "age")


@query(f"WITH {PLACES_SQL}, k AS (SELECT DISTINCT location, session, grp FROM places WHERE grp < 12) SELECT response_key, p.location, p.session, p.grp, k.grp IS NOT NULL AS matched FROM places p LEFT JOIN k ON p.location IS NOT DISTINCT FROM k.location AND p.session IS NOT DISTINCT FROM k.session AND p.grp IS NOT DISTINCT FROM k.grp")
def j02_null_safe_join(spark, sf_dir):
    p = surveys.place_responses(spark, sf_dir)
    k = p.filter("grp < 12").select(F.col("location").alias("kl"), F.col("session").alias("ks"), F.col("grp").alias("kg")).distinct()
    same = p["location"].eqNullSafe(k["kl"]) & p["session"].eqNullSafe(k["ks"]) & p["grp"].eqNullSafe(k["kg"])
    return p.join(k, same, "left").select("response_key", "location", "session", "grp", F.col("kg").isNotNull().alias("matched"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey IS NOT NULL)")
def j05_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").filter("c_nationkey % 3 = 0")
    return checks.orphans(table(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH {STIMULUS_SQL}, k AS (SELECT DISTINCT fold, soundscape, masker, smr FROM stimulus) SELECT *, printf('STIM_%06d', row_number() OVER (ORDER BY fold NULLS LAST, soundscape NULLS LAST, masker NULLS LAST, smr NULLS LAST)) AS clip_id FROM k")
def w01_clip_numbers(spark, sf_dir):
    keys = ["fold", "soundscape", "masker", "smr"]
    numbered = numbering.dense_numbers(surveys.stimulus_responses(spark, sf_dir).select(*keys).distinct(), keys)
    return numbered.select(*keys, F.format_string("STIM_%06d", "number").alias("clip_id"))


@query(f"WITH {PLACES_SQL}, i AS (SELECT response_key, coalesce(location, 'none') || '_' || session || '_' || grp AS id FROM places) SELECT response_key, id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN id || printf('_R%02d', row_number() OVER w - 1) ELSE id END AS unique_id FROM i WINDOW w AS (PARTITION BY id ORDER BY response_key)")
def w03_repeat_suffixes(spark, sf_dir):
    rows = surveys.place_responses(spark, sf_dir).select("response_key", F.concat_ws("_", F.coalesce("location", F.lit("none")), "session", "grp").alias("id"))
    return numbering.suffix_repeats(rows, "id", ["response_key"], "unique_id", once=False)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def w05_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return numbering.last_wins(rows, ["user_id", "event_type"], ["event_id"])


@query(f"WITH {FRAMES_SQL} SELECT clip, class_name, count(*) AS n_frames, {even('sum(cents)::DOUBLE / (40000 * count(*))', 6)} AS mean_ratio, {even('sqrt((count(*) * sum(cents * cents) - sum(cents) * sum(cents))::DOUBLE) / (40000 * count(*))', 6)} AS std_ratio, {even('min(cents)::DOUBLE / 40000', 6)} AS min_ratio, {even('max(cents)::DOUBLE / 40000', 6)} AS max_ratio FROM frames GROUP BY clip, class_name")
def a08_frame_statistics(spark, sf_dir):
    return aggregates.frame_statistics(surveys.frames(spark, sf_dir), 40000)


@query("""WITH t AS (SELECT user_id AS clip, event_type AS class_name, sum(event_id % 3)::BIGINT AS cents, min(event_id) AS pos FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY cents DESC, pos) AS rank FROM t) SELECT clip, rank, class_name, cents FROM r WHERE rank <= 3""")
def o03_top_classes(spark, sf_dir):
    """Small whole shares, so that many classes tie and the first seen decides."""
    totals = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip"), F.col("event_type").alias("class_name"))
    return aggregates.top_classes(totals.agg(F.sum(F.col("event_id") % 3).alias("cents"), F.min("event_id").alias("pos")), 3)


@query("WITH n AS (SELECT vec_id, 'new' AS origin FROM embeddings WHERE vec_id % 3 = 0) SELECT vec_id, 'old' AS origin FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n")
def u03_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    new = e.filter("vec_id % 3 = 0").select("vec_id", F.lit("new").alias("origin"))
    return numbering.upsert(e.select("vec_id", F.lit("old").alias("origin")), new, ["vec_id"])


@query("""WITH l AS (SELECT *, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'many' ELSE l_quantity::VARCHAR END AS cell FROM lineitem)
SELECT l_orderkey AS row_key, field, rule, count(*) AS n FROM (
SELECT l_orderkey, 'l_quantity' AS field, 'maximum' AS rule FROM l WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, 'l_discount', 'minimum' FROM l WHERE l_discount < 0.02
UNION ALL SELECT l_orderkey, 'l_returnflag', 'enum' FROM l WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT l_orderkey, 'cell', 'required' FROM l WHERE coalesce(cell, '') = '' UNION ALL SELECT l_orderkey, 'cell', 'type' FROM l WHERE cell = 'many'
UNION ALL SELECT l_orderkey, 'l_linestatus', 'pattern' FROM l WHERE NOT regexp_full_match(l_linestatus, '[A-N]')) GROUP BY 1, 2, 3""")
def v01_constraints(spark, sf_dir):
    fields = [checks.Field("l_quantity", required=True, maximum=45), checks.Field("l_discount", minimum=0.02), checks.Field("l_returnflag", enum=("A", "N")), checks.Field("l_linestatus", pattern="[A-N]"), checks.Field("cell", "number", required=True)]
    rows = table(spark, sf_dir, "lineitem").withColumn("cell", F.expr("CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'many' ELSE cast(l_quantity AS string) END"))
    return checks.row_findings(rows, "l_orderkey", fields).groupBy("row_key", "field", "rule").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def a11_repeated_keys(spark, sf_dir):
    return checks.repeated_keys(table(spark, sf_dir, "orders"), "o_custkey")
