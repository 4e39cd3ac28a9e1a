"""Queries of the builders over tables shaped like surveys, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earshot.functions import scores, texts
from earshot.functions.scores import ITEMS
from earshot.operators import aggregates, builders, harmonise, numbering, tables, upserts
from earshot.operators.builders import STIMULUS_KEYS
from earshot.plans.base import query
from earshot.plans.registry import COORDINATES, E_SQL, P_SQL, even
from earshot.sources import surveys
from earshot.sources.surveys import FRAMES_SQL, PARTICIPANTS_SQL, PLACES_SQL, STIMULUS_SQL, table

_SITE = "concat_ws('_', 'SITE', coalesce(location, 'nan'), session, grp)"
_ITEMS = ", ".join(ITEMS)


@query(f"WITH {PLACES_SQL} SELECT {_SITE} AS clip_id, {_SITE} || '_R' || response_key AS response_id, {_ITEMS}, {even(P_SQL, 4)} AS iso_pleasant, {even(E_SQL, 4)} AS iso_eventful FROM places")
def b01_site_responses(spark, sf_dir):
    """One row for each response, ids from its parts, coordinates to four decimals."""
    return builders.site_responses(surveys.place_responses(spark, sf_dir))


@query(f"WITH {PLACES_SQL}, m AS (SELECT location, session, grp, count(*) AS n, " + ", ".join(f"{even(f'avg({i})', 3)} AS {i}" for i in ITEMS)
       + f", min(response_key) AS first_response_key, arg_min(calm, response_key) AS first_calm FROM places WHERE location IS NOT NULL GROUP BY ALL) SELECT concat_ws('_', 'SITE', location, session, grp) AS clip_id, n, {_ITEMS}, {even(P_SQL, 4)} AS iso_pleasant, {even(E_SQL, 4)} AS iso_eventful, first_response_key, first_calm FROM m")
def b02_site_clips(spark, sf_dir):
    """Clips of responses on site, coordinates from rounded means, other columns from the first response."""
    return builders.site_clips(surveys.place_responses(spark, sf_dir), ["response_key", "calm"])


_STIMULI = f"""{STIMULUS_SQL}, {PARTICIPANTS_SQL}, kept AS (SELECT s.*, language, age, {COORDINATES} FROM stimulus s LEFT JOIN participants USING (participant) WHERE fold BETWEEN -1 AND 7),
announced AS (SELECT p_partkey % 9 - 1 AS fold, 'R' || lpad((p_size % 40)::VARCHAR, 4, '0') AS soundscape, CASE WHEN p_partkey % 2 = 0 THEN 'quiet' ELSE 'NO' END AS masker, 0::BIGINT AS smr FROM part),
keys AS (SELECT *, printf('STIM_%06d', row_number() OVER (ORDER BY fold NULLS LAST, soundscape NULLS LAST, masker NULLS LAST, smr NULLS LAST)) AS clip_id FROM (SELECT fold, soundscape, masker, smr FROM kept UNION SELECT fold, soundscape, masker, smr FROM announced)),
placed AS (SELECT kept.*, clip_id, printf('STIM_%d_S%02d', participant, line) AS id FROM kept JOIN keys ON kept.fold IS NOT DISTINCT FROM keys.fold AND kept.soundscape IS NOT DISTINCT FROM keys.soundscape AND kept.masker IS NOT DISTINCT FROM keys.masker AND kept.smr IS NOT DISTINCT FROM keys.smr)"""
_SPLIT = "CASE WHEN fold = -1 THEN 'aux' WHEN fold IN (0, 6, 7) THEN 'test' WHEN fold = 5 THEN 'dev' ELSE 'train' END"


def _stimuli(spark, sf_dir, shared=False):
    """Responses and clips of masked stimuli, from one table if both are read; some announced stimuli have no response."""
    raw = surveys.stimulus_responses(spark, sf_dir).withColumnRenamed("response_key", "source_key")
    builders.require_columns(raw, ["source_key", "line", "participant", *STIMULUS_KEYS, *ITEMS], "responses")
    kept = raw.withColumnsRenamed({"source_key": "response_key"}).filter("fold BETWEEN -1 AND 7")
    announced = table(spark, sf_dir, "part").selectExpr("p_partkey % 9 - 1 AS fold", "concat('R', lpad(cast(p_size % 40 AS string), 4, '0')) AS soundscape", "CASE WHEN p_partkey % 2 = 0 THEN 'quiet' ELSE 'NO' END AS masker", "0L AS smr")
    return builders.stimulus_tables(kept, surveys.participants(spark, sf_dir), announced, "STIM_", shared)


@query(f"WITH {_STIMULI} SELECT clip_id, response_key, line, part_key, language, age, iso_pleasant, iso_eventful, id || CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN printf('_R%02d', row_number() OVER (PARTITION BY id ORDER BY response_key, part_key, clip_id) - 1) ELSE '' END AS response_id FROM placed")
def b03_stimulus_responses(spark, sf_dir):
    """Responses to masked stimuli: renamed, filtered, joined to people and stimuli, ids made unique."""
    responses, _ = _stimuli(spark, sf_dir)
    told = responses.select("clip_id", "response_key", "line", "part_key", "language", "age", "iso_pleasant", "iso_eventful", F.format_string("STIM_%d_S%02d", "participant", "line").alias("id"))
    return numbering.suffix_repeats(told, "id", ["response_key", "part_key", "clip_id"], "response_id").drop("id")


_MICRO = lambda c: even(f"sum(round_even({c} * 1000000, 0)::BIGINT)::DOUBLE / (count({c}) * 1000000)", 4)


@query(f"WITH {_STIMULI} SELECT k.clip_id, k.fold, k.soundscape, k.masker, k.smr, {_SPLIT} AS split, k.fold = -1 AS is_common, coalesce(n, 0) AS n, mean_calm, p AS iso_pleasant FROM keys k LEFT JOIN (SELECT clip_id, count(*) AS n, {even('avg(calm)', 4)} AS mean_calm, {_MICRO('iso_pleasant')} AS p FROM placed GROUP BY clip_id) USING (clip_id)")
def b03_stimulus_clips(spark, sf_dir):
    """All stimuli with the aggregates of their responses, none for those only announced."""
    return _clip_columns(_stimuli(spark, sf_dir)[1])


def _clip_columns(clips):
    split = scores.split_of(F.col("fold"), F.lit(5)).alias("split")
    rounded = [scores.half_even(F.col(c), 4).alias(c) for c in ("mean_calm", "iso_pleasant")]
    return clips.select("clip_id", *STIMULUS_KEYS, split, (F.col("fold") == -1).alias("is_common"), "n", *rounded)


@query(f"WITH {_STIMULI}, clips AS (SELECT k.clip_id, {_SPLIT} AS split, coalesce(n, 0) AS n FROM keys k LEFT JOIN (SELECT clip_id, count(*) AS n FROM placed GROUP BY clip_id) USING (clip_id)), "
       "responses AS (SELECT clip_id, count(*) AS n, count(language) AS known FROM placed GROUP BY clip_id) "
       "SELECT split, count(*) AS clips, sum(c.n)::BIGINT AS counted, coalesce(sum(r.n), 0)::BIGINT AS responses, coalesce(sum(known), 0)::BIGINT AS known FROM clips c LEFT JOIN responses r USING (clip_id) GROUP BY split")
def b03_both_outputs(spark, sf_dir):
    """Clips and responses of one table set against each other by split: what clips count is what responses there are."""
    responses, clips = _stimuli(spark, sf_dir, shared=True)
    told = responses.groupBy("clip_id").agg(F.count("*").alias("n"), F.count("language").alias("known")).withColumnsRenamed({"n": "_n"})
    both = _clip_columns(clips).join(told, "clip_id", "left").groupBy("split")
    return both.agg(F.count("*").alias("clips"), F.sum("n").alias("counted"), F.coalesce(F.sum("_n"), F.lit(0)).alias("responses"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"))


RATED = "SELECT event_id AS row, CASE WHEN event_id % 23 = 0 THEN '  ' ELSE concat(' ', event_type, ' no. ', user_id % 5, ' ') END AS recording, concat(' P', user_id, ' ') AS participant, concat('L', user_id % 18) AS language, " + ", ".join(
    f"CASE WHEN (event_id + {i}) % 11 = 0 THEN '' ELSE concat(' ', (event_id * {i}) % 112) END AS {item}" for i, item in enumerate(ITEMS, 1)) + ", CASE WHEN event_id % 7 = 0 THEN ' ' ELSE concat(event_id % 90, '.5') END AS loud FROM events"
_RATED_ROWS = f"""raw AS ({RATED}), kept AS (SELECT row, trim(recording) AS recording, trim(participant) AS participant, language, 'RATED_' || regexp_replace(regexp_replace(trim(recording), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS clip_id,
{", ".join(f"CASE WHEN try_cast(trim({i}) AS DOUBLE) BETWEEN 0 AND 100 THEN 1 + 4 * try_cast(trim({i}) AS DOUBLE) / 100 END AS {i}" for i in ITEMS)}, try_cast(trim(loud) AS DOUBLE) AS loud FROM raw WHERE trim(recording) <> ''),
rated AS (SELECT *, printf('RATED_%06d', row_number() OVER (ORDER BY row)) AS response_id FROM kept)"""


def _raw_ratings(spark, sf_dir):
    return spark.sql(RATED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"WITH {_RATED_ROWS} SELECT response_id, clip_id, recording, participant, language, {_ITEMS}, loud, {even(P_SQL, 6)} AS iso_pleasant, {even(E_SQL, 6)} AS iso_eventful FROM rated")
def b04_rated_responses(spark, sf_dir):
    """Ratings of 0 to 100 as five-point values with sequential ids."""
    rounded = {c: scores.half_even(F.col(c), 6) for c in ("iso_pleasant", "iso_eventful")}
    return builders.rated_responses(_raw_ratings(spark, sf_dir)).withColumns(rounded).select("response_id", "clip_id", "recording", "participant", "language", *ITEMS, "loud", "iso_pleasant", "iso_eventful")


_MEANS = ", ".join(f"sum(round_even({i} * 10000, 0)::BIGINT)::DOUBLE / (count({i}) * 10000) AS {i}" for i in ITEMS)


@query(f"WITH {_RATED_ROWS}, m AS (SELECT clip_id, count(*) AS n_responses, count(DISTINCT participant) AS n_participants, count(DISTINCT language) AS n_languages, arg_min(recording, row) AS recording, {_MEANS}, sum(round_even(loud * 100, 0)::BIGINT)::DOUBLE / (count(loud) * 100) AS loud FROM rated GROUP BY clip_id) "
       + "SELECT clip_id, n_responses, n_participants, n_languages, recording, 'rated/' || recording || '.wav' AS audio_asset, " + ", ".join(f"printf('%.6g', {x})::DOUBLE AS {n}" for x, n in [*((i, i) for i in ITEMS), ("loud", "loud")]) + f", {even(P_SQL, 4)} AS iso_pleasant, {even(E_SQL, 4)} AS iso_eventful FROM m")
def b04_rated_clips(spark, sf_dir):
    """Clips of rated responses, numbers by six digits (A03, P10): no id of a response is needed, so one shuffle."""
    clips = builders.rated_clips(builders.rated_rows(_raw_ratings(spark, sf_dir)))
    numbers = [*ITEMS, "loud"]  # one expression for all of them
    clips = clips.withColumn("six", F.transform(F.array(*numbers), builders.six_digits))
    six = {c: F.get("six", F.lit(i)) for i, c in enumerate(numbers)}
    rounded = {c: scores.half_even(F.col(c), 4) for c in ("iso_pleasant", "iso_eventful")}
    return clips.withColumns(six | rounded).select("clip_id", "n_responses", "n_participants", "n_languages", "recording", "audio_asset", *ITEMS, "loud", "iso_pleasant", "iso_eventful")


LABELS = ["Al", "Non-the", "lorem", "Is  it", "of", "water"]


@query("SELECT doc_id, " + ", ".join(f"contains(lower(coalesce(text, '')), '{x.lower()}')::INT AS {builders.label_column(x)}" for x in LABELS) + ", try_cast(n_chars AS BIGINT) % 10 + 1 AS annoyance FROM documents")
def b05_flagged_responses(spark, sf_dir):
    """Responses with a flag for each source label that their text names."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars").cast("bigint") % 10 + 1).alias("annoyance"))
    return builders.flagged_responses(rows, LABELS, "text").drop("text")


@query("SELECT 'COLLAPSED_' || regexp_replace(regexp_replace(regexp_replace(p_name || '.v2.wav', '\\.[^.]*$', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS clip_id, p_partkey AS n, 'train' AS split, 0.0::DOUBLE AS start_s, 30.0::DOUBLE AS end_s FROM part WHERE p_size > 10")
def b06_collapsed_clips(spark, sf_dir):
    """Clips of a sheet of majorities: ids without the last extension, constants."""
    stem = F.regexp_replace(F.concat("p_name", F.lit(".v2.wav")), r"\.[^.]*$", "")
    rows = table(spark, sf_dir, "part").filter("p_size > 10")
    return rows.select(scores.safe_id(stem, "COLLAPSED_").alias("clip_id"), F.col("p_partkey").alias("n"), F.lit("train").alias("split"), F.lit(0.0).alias("start_s"), F.lit(30.0).alias("end_s"))


@query("SELECT 'clipemb_' || vec_id AS feature_id, vec_id::VARCHAR AS clip_id, 'visual_clip_embedding' AS feature_type, 'base64' AS value_format, len(embedding)::INT AS embedding_dim, 'float32' AS dtype, 'center_frame' AS pooling, 'ViT-B-32' AS model_name, (ceil(len(embedding) * 4 / 3.0) * 4)::INT AS encoded_length FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 <> 0")
def b09_embedding_records(spark, sf_dir):
    """Records of clips that have a vector (P41, J04, S19); the text of a vector is tested against numpy."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("clip_id"), "embedding", "vec_id")
    made, _ = builders.embedding_records(rows.select("clip_id"), rows.filter("vec_id % 3 <> 0"), "ViT-B/32")
    return made.select("feature_id", "clip_id", "feature_type", "value_format", "embedding_dim", "dtype", "pooling", "model_name", F.length("embedding_base64").alias("encoded_length"))


GROUPS = {"seen": ["view", "click"], "done": ["purchase", "signup"]}


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT clip, class_name, count(*) AS n, sum(cents)::BIGINT AS s FROM frames GROUP BY 1, 2), means AS (SELECT clip, class_name, {even('s::DOUBLE / (40000 * n)', 6)} AS ratio FROM c),
counted AS (SELECT user_id AS clip, count(DISTINCT ts::DATE) AS frames FROM events GROUP BY 1)
SELECT 'summary_' || clip || '_v1' AS feature_id, clip::VARCHAR AS clip_id, CASE WHEN clip % 4 = 0 THEN 'path' ELSE 'json' END AS value_format, CASE WHEN clip % 4 = 0 THEN 'features/' || clip ELSE '' END AS feature_path, coalesce(nullif(CASE WHEN clip % 3 = 0 THEN 0 ELSE clip % 3 END, 0), frames) AS sampled_frame_count,
CASE WHEN clip % 2 = 0 THEN 'every day' ELSE 'unknown' END AS frame_sampling_rule, max(ratio) AS largest_ratio, count(*) AS classes FROM means JOIN counted USING (clip) GROUP BY clip, frames""")
def b10_summary_records(spark, sf_dir):
    """Summary records of clips from their frames: defaults where a summary is silent, value format by its path."""
    frames = surveys.frames(spark, sf_dir)
    ratios = aggregates.frame_statistics(frames, 40000).groupBy("clip").agg(F.max("mean_ratio").alias("largest_ratio"), F.count("*").alias("classes"))
    counted = frames.select("clip", "frame").distinct().groupBy("clip").agg(F.count("*").alias("frames"))
    said = ratios.join(counted, "clip").selectExpr("*", "clip % 3 AS said_count", "CASE WHEN clip % 2 = 0 THEN 'every day' END AS said_rule", "CASE WHEN clip % 4 = 0 THEN concat('features/', clip) ELSE '' END AS feature_path")
    count = F.coalesce(F.nullif("said_count", F.lit(0)), F.greatest("frames", F.lit(1)))
    return said.select(F.concat(F.lit("summary_"), F.col("clip").cast("string"), F.lit("_v1")).alias("feature_id"), F.col("clip").cast("string").alias("clip_id"), F.when(F.col("feature_path") == "", "json").otherwise("path").alias("value_format"), "feature_path",
                       count.alias("sampled_frame_count"), F.coalesce("said_rule", F.lit("unknown")).alias("frame_sampling_rule"), "largest_ratio", "classes")


@query(f"WITH {PLACES_SQL} SELECT response_key, " + ", ".join(f"CASE WHEN response_key % 3 = 0 THEN NULL ELSE {i} + 1 END AS {i}" if n % 2 else f"{i} AS {i}" for n, i in enumerate(ITEMS)) + " FROM places")
def p06_item_names(spark, sf_dir):
    """Items under their own names from columns with other names, later ones deciding."""
    rows = surveys.place_responses(spark, sf_dir)
    wide = rows.select("response_key", *[F.col(i).alias(f"PAQ{n + 1}_{i}") for n, i in enumerate(ITEMS)], *[F.when(F.col("response_key") % 3 != 0, F.col(i) + 1).alias(f"mean_PAQ{n + 1}_{i}") for n, i in enumerate(ITEMS) if n % 2])
    return wide.select("response_key", *[c.alias(i) for i, c in builders.canonical_items(wide).items()])


@query("SELECT event_id, printf('%.6g', value / 7)::DOUBLE AS six FROM events WHERE value IS NOT NULL")
def p10_six_digits(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", builders.six_digits(F.col("value") / 7).alias("six"))


@query(f"WITH {PLACES_SQL} SELECT response_key, pleasant + 1 AS mean_pleasant, calm AS mean_calm FROM places")
def p34_map_columns(spark, sf_dir):
    """Members of a JSON object of unknown keys as columns, by a pivot over the keys that occur."""
    rows = surveys.place_responses(spark, sf_dir).select("response_key", F.to_json(F.struct((F.col("pleasant") + 1).alias("pleasant"), "calm")).alias("value"))
    pairs = rows.select("response_key", F.explode(F.from_json("value", "map<string,double>")).alias("k", "v"))
    return pairs.groupBy("response_key").pivot("k").agg(F.first("v")).select("response_key", F.col("pleasant").alias("mean_pleasant"), F.col("calm").alias("mean_calm"))


@query(f"WITH {STIMULUS_SQL}, c AS (SELECT {COORDINATES} FROM stimulus) SELECT floor(iso_pleasant / 0.25)::BIGINT AS x, floor(iso_eventful / 0.25)::BIGINT AS y, count(*) AS n FROM c WHERE iso_pleasant IS NOT NULL AND iso_eventful IS NOT NULL GROUP BY ALL")
def p43_circumplex(spark, sf_dir):
    """Counts of responses in squares of the plane of coordinates."""
    rows = aggregates.with_coordinates(surveys.stimulus_responses(spark, sf_dir)).dropna(subset=["iso_pleasant", "iso_eventful"])
    square = lambda c: F.floor(F.col(c) / 0.25).cast("long")
    return rows.groupBy(square("iso_pleasant").alias("x"), square("iso_eventful").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'index' WHEN p_partkey % 3 = 0 THEN 'json' WHEN p_partkey % 5 = 0 THEN 'csv' END AS found FROM part")
def j04_summary_lookup(spark, sf_dir):
    """For each clip the summary of the first kind that has one (S10, S11): kinds are read once, the least rank stays."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    kinds = [(2, "index"), (3, "json"), (5, "csv")]
    listed = [parts.filter(F.col("p_partkey") % k == 0).select("p_partkey", F.lit(name).alias("found"), F.lit(rank).alias("rank")) for rank, (k, name) in enumerate(kinds)]
    first = builders.first_of(listed[0].unionByName(listed[1]).unionByName(listed[2]), "p_partkey", "rank")
    return parts.join(first, "p_partkey", "left").select("p_partkey", "found")


@query("WITH d AS (SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (N' || n_nationkey || ')' ELSE '' END AS dataset_name FROM nation) SELECT c_custkey, dataset_name FROM customer LEFT JOIN d ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def j07_clip_datasets(spark, sf_dir):
    """Clips joined to datasets by the short form of a dataset's name."""
    named = table(spark, sf_dir, "nation").select(F.expr("concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN concat(' (N', n_nationkey, ')') ELSE '' END)").alias("dataset_name"))
    named = named.withColumn("dataset_id", texts.short_name(F.col("dataset_name")))
    clips = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dataset_id"))
    return clips.join(named, "dataset_id", "left").select("c_custkey", "dataset_name")


@query("SELECT event_id, printf('E_%06d', row_number() OVER (ORDER BY event_id)) AS response_id, row_number() OVER (ORDER BY event_id) + 1 AS row_number FROM events WHERE event_type <> 'error'")
def w02_sequential_ids(spark, sf_dir):
    """Ids 1 to N of kept rows in source order, and their row numbers in a file with a header."""
    kept = table(spark, sf_dir, "events").filter("event_type <> 'error'").select("event_id")
    return builders.row_numbers(kept, ["event_id"]).withColumn("response_id", texts.padded_id("E_", F.col("row_number") - 1, 6))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def o02_sorted_names(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 3")
def o04_head(spark, sf_dir):
    """The first three rows of a resource."""
    return builders.head_of(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 3)


FEATURES = "SELECT event_id AS pos, concat('f', event_id % 5000) AS feature_id, CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('c', user_id) END AS clip_id, CASE event_type WHEN 'view' THEN 'visual_semantic_summary' WHEN 'click' THEN 'visual_clip_embedding' ELSE 'other' END AS feature_type FROM events"


def _features(spark, sf_dir):
    return spark.sql(FEATURES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"WITH f AS ({FEATURES}), n AS (SELECT * FROM f WHERE pos % 2 = 0 AND feature_type = 'visual_clip_embedding') SELECT * FROM f WHERE NOT (feature_type = 'visual_clip_embedding' AND clip_id <> '') UNION ALL SELECT * FROM n")
def u02_replaced_embeddings(spark, sf_dir):
    """Append mode: all embedding records that name a clip give way to the new ones."""
    rows = _features(spark, sf_dir)
    return builders.replaced(rows, rows.filter("pos % 2 = 0 AND feature_type = 'visual_clip_embedding'"), "visual_clip_embedding")


@query(f"WITH f AS ({FEATURES}), n AS (SELECT * FROM f WHERE pos % 2 = 0 AND feature_type = 'visual_clip_embedding') SELECT * FROM f WHERE NOT (feature_type = 'visual_clip_embedding' AND clip_id <> '' AND clip_id IN (SELECT clip_id FROM n)) UNION ALL SELECT * FROM n")
def u02_replaced_by_clip(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return builders.replaced(rows, rows.filter("pos % 2 = 0 AND feature_type = 'visual_clip_embedding'"), "visual_clip_embedding", scope="clip")


@query(f"WITH f AS ({FEATURES}), n AS (SELECT max(pos) AS pos, feature_id, arg_max(clip_id, pos) AS clip_id, 'visual_semantic_summary' AS feature_type FROM f WHERE feature_type = 'visual_semantic_summary' AND pos % 3 = 0 GROUP BY feature_id) SELECT * FROM f WHERE feature_type <> 'visual_semantic_summary' AND feature_id NOT IN (SELECT feature_id FROM n) UNION ALL SELECT * FROM n")
def u03_replaced_summaries(spark, sf_dir):
    """Old summaries go, and records whose id a new summary has; of new ones with one id the last stays."""
    rows = _features(spark, sf_dir)
    return builders.replaced_by_id(rows, rows.filter("feature_type = 'visual_semantic_summary' AND pos % 3 = 0"), "visual_semantic_summary")


_LAID = FEATURES.replace("SELECT event_id AS pos,", "SELECT event_id AS pos, concat('d', user_id % 3) AS dataset_id,")


@query(f"WITH f AS ({_LAID}), n AS (SELECT * FROM f WHERE pos % 2 = 0 AND feature_type = 'visual_clip_embedding' AND clip_id <> '' AND dataset_id = 'd1') SELECT * FROM f WHERE NOT (feature_type = 'visual_clip_embedding' AND (dataset_id, clip_id) IN (SELECT (dataset_id, clip_id) FROM n)) UNION ALL SELECT * FROM n")
def u02_upsert_by_folder(spark, sf_dir):
    """A table by dataset and bucket, of which an upsert rewrites what holds its clips, twice over, as after a failure."""
    rows = spark.sql(_LAID.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    path, kind = f"{tables.shared_folder(spark)}/features-{uuid.uuid4().hex}", "pos long, dataset_id string, feature_id string, clip_id string, feature_type string"
    upserts.write_table(rows, path, 4)
    new = rows.filter("pos % 2 = 0 AND feature_type = 'visual_clip_embedding' AND clip_id <> '' AND dataset_id = 'd1'")
    for _ in range(2):
        upserts.upsert_clips(path, new, kind, "visual_clip_embedding", 4)
    return upserts.read_table(spark, path, kind).drop("bucket")


@query(f"WITH {PLACES_SQL} " + " UNION ALL ".join(f"SELECT response_key, '{i}' AS item, {i} AS value, '{i}' AS original_field, 'raw_response' AS value_type, NULL::VARCHAR AS aggregation FROM places" for i in ITEMS))
def h03_item_objects(spark, sf_dir):
    """The items of responses as records with where they come from."""
    return builders.item_objects(surveys.place_responses(spark, sf_dir), ["response_key"], "raw_response", None)


@query("SELECT p_partkey, g AS feature_group, n AS name, CASE n WHEN 'p_size' THEN p_size ELSE p_retailprice END::DOUBLE AS value, u AS unit, 'part table' AS provenance FROM part, (VALUES ('acoustic_indicators', 'p_size', 'dB'), ('psychoacoustic_indicators', 'p_retailprice', 'sone')) t(g, n, u)")
def h04_feature_groups(spark, sf_dir):
    groups = {"acoustic_indicators": [("p_size", "dB")], "psychoacoustic_indicators": [("p_retailprice", "sone")]}
    return builders.feature_groups(table(spark, sf_dir, "part"), "p_partkey", groups, "part table")


@query(f"WITH {STIMULUS_SQL} SELECT response_key, line, part_key, CASE WHEN masker <> 'AF' THEN 'available' ELSE 'not_reported' END AS audio_view, CASE WHEN pleasant IS NULL AND calm IS NULL THEN 'not_reported' WHEN pleasant IS NULL OR calm IS NULL THEN 'partial' ELSE 'available' END AS perception_view FROM stimulus")
def h05_views(spark, sf_dir):
    there, whole = F.col("pleasant").isNotNull() | F.col("calm").isNotNull(), F.col("pleasant").isNotNull() & F.col("calm").isNotNull()
    return surveys.stimulus_responses(spark, sf_dir).select("response_key", "line", "part_key", builders.view_status(F.col("masker") != "AF").alias("audio_view"), builders.view_status(there, whole).alias("perception_view"))


@query(f"WITH {PLACES_SQL} SELECT location, {even('(count(pleasant) + count(location) + count(*) FILTER (grp < 10))::DOUBLE / (3 * count(*))', 6)} AS score FROM places GROUP BY location")
def h07_potential(spark, sf_dir):
    """How far the responses of a location can be harmonised: the mean of three shares (a definition of this engine)."""
    rows = surveys.place_responses(spark, sf_dir)
    share = (F.count("pleasant") + F.count("location") + F.count_if(F.col("grp") < 10)) / (3 * F.count("*"))
    return rows.groupBy("location").agg(scores.half_even(share, 6).alias("score"))


@query("SELECT s_nationkey AS dataset_id, CASE s_suppkey % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'not_performed' WHEN 2 THEN 'unknown' ELSE 'partially_aligned' END AS status, count(*) AS n FROM supplier GROUP BY ALL")
def h08_checklist_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS dataset_id", "CASE s_suppkey % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'not_performed' WHEN 2 THEN 'unknown' ELSE 'partially_aligned' END AS status")
    return rows.groupBy("dataset_id", "status").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS dataset_id, bool_or(s_suppkey % 4 = 1) AS has_not_performed FROM supplier GROUP BY 1")
def a16_status_sets(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("dataset_id")).agg(F.bool_or(F.col("s_suppkey") % 4 == 1).alias("has_not_performed"))


@query("SELECT confidence, evidence, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE c_custkey % 2 WHEN 0 THEN 'paper' ELSE 'metadata_file' END AS evidence FROM customer) GROUP BY ALL")
def h11_mapping_audit(spark, sf_dir):
    """How many mappings have each confidence and evidence."""
    rows = table(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence", "CASE c_custkey % 2 WHEN 0 THEN 'paper' ELSE 'metadata_file' END AS evidence")
    return rows.groupBy("confidence", "evidence").agg(F.count("*").alias("n"))


@query(f"WITH {PLACES_SQL} SELECT response_key, pleasant, calm, vibrant FROM places")
def h10_wide_items(spark, sf_dir):
    """Items from long to wide form again."""
    long = harmonise.long_items(surveys.place_responses(spark, sf_dir), ["response_key"], ITEMS)
    return long.groupBy("response_key").pivot("item", list(ITEMS)).agg(F.first("value")).select("response_key", "pleasant", "calm", "vibrant")
