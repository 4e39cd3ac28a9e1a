"""Queries of cell parsing, feature records and harmonised records, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import scores, texts
from earshot.functions.scores import ITEMS
from earshot.operators import checks, harmonise, records
from earshot.plans.base import query
from earshot.sources import surveys
from earshot.sources.surveys import FRAMES_SQL, PLACES_SQL, STIMULUS_SQL, table

CELLS = "CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', p_size, '.9 ') ELSE p_name END"
ASSETS = "concat('rec_', p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('_segment_', p_size) ELSE '' END, '.wav')"
MODELS = "CASE p_size % 3 WHEN 0 THEN 'ViT-B/32' WHEN 1 THEN 'ViT-L/14' ELSE concat('RN/', p_size) END"
SIZES = "concat(p_size, '.5 ', CASE p_partkey % 3 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' ELSE 'GB' END)"
NAMES = "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN concat(' (', p_brand, ')') ELSE '' END)"


@query(f"SELECT p_partkey, nullif(trim(cell), '') AS kept, trunc(try_cast(trim(cell) AS DOUBLE))::BIGINT AS whole, coalesce(try_cast(trim(cell) AS DOUBLE), 0) AS number FROM (SELECT p_partkey, {CELLS} AS cell FROM part)")
def p14_cells(spark, sf_dir):
    cell = F.expr(CELLS)
    return table(spark, sf_dir, "part").select("p_partkey", texts.blank_to_null(cell).alias("kept"), texts.whole_number(cell).alias("whole"), texts.number_or(cell).alias("number"))


#: Spellings of numbers with the value that SQL gives; None for none.
SPELLED = [("1.5", "1.5"), ("0.5d", None), ("0.5f", None), ("0x1p-1", None), (" 2. ", "2"), (".25", "0.25"), ("1e3", "1000"), ("-7", "-7"), ("+1_000", "1000"), ("1__0", None), ("_1", None), (".", None), ("1e", None), ("NaN", None)]
_SPELLINGS = "CASE p_partkey % {n} {cases} END".format(n=len(SPELLED), cases=" ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(SPELLED)))


@query("SELECT p_partkey, CASE p_partkey % {n} {cases} ELSE -1 END::DOUBLE AS number FROM part".format(n=len(SPELLED), cases=" ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(SPELLED) if v)))
def p15_spelled_numbers(spark, sf_dir):
    """Texts as numbers, -1 for all that spell none."""
    return table(spark, sf_dir, "part").select("p_partkey", texts.number_or(F.expr(_SPELLINGS), -1.0).alias("number"))


@query("SELECT p_partkey AS row_key, 'cell' AS field, 'type' AS rule FROM part WHERE p_partkey % {n} IN ({bad})".format(n=len(SPELLED), bad=", ".join(str(i) for i, (_, v) in enumerate(SPELLED) if v is None)))
def v01_spelled_numbers(spark, sf_dir):
    """Cells of a column of numbers that spell none."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPELLINGS).alias("cell"))
    return checks.row_findings(rows, "p_partkey", [checks.Field("cell", "number")])


@query(f"WITH {PLACES_SQL} SELECT response_key, concat_ws('_', 'SITE', location, session, grp) AS clip_id, printf('R_%06d', response_key) AS response_id FROM places")
def p16_composite_ids(spark, sf_dir):
    rows = surveys.place_responses(spark, sf_dir)
    return rows.select("response_key", texts.composite_id("SITE", F.col("location"), F.col("session"), F.col("grp")).alias("clip_id"), texts.padded_id("R_", F.col("response_key"), 6).alias("response_id"))


@query(rf"SELECT p_partkey, regexp_replace(raw, '_segment_.*$', '') || '_360' AS asset, regexp_replace(regexp_replace(raw, '\.wav$', ''), '_segment_.*$', '') || '_360' AS bare FROM (SELECT p_partkey, {ASSETS} AS raw FROM part)")
def p20_asset_ids(spark, sf_dir):
    raw = F.expr(ASSETS)
    return table(spark, sf_dir, "part").select("p_partkey", texts.asset_id(raw).alias("asset"), texts.asset_id(raw, strip_ext=True).alias("bare"))


@query("SELECT p_partkey, try_cast(nullif(regexp_extract(CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE concat('about ', p_size, ' or ', p_partkey) END, '[0-9]+'), '') AS BIGINT) AS first FROM part")
def p24_first_integers(spark, sf_dir):
    text = F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE concat('about ', p_size, ' or ', p_partkey) END")
    return table(spark, sf_dir, "part").select("p_partkey", texts.first_integer(text).alias("first"))


@query("SELECT event_id, to_json({'id': event_id, 'kind': event_type, 'user': CASE WHEN event_id % 5 <> 0 THEN user_id END})::VARCHAR AS payload FROM events")
def p38_payloads(spark, sf_dir):
    user = F.expr("CASE WHEN event_id % 5 <> 0 THEN user_id END")
    return table(spark, sf_dir, "events").select("event_id", records.payload(id=F.col("event_id"), kind=F.col("event_type"), user=user).alias("payload"))


@query(f"SELECT p_partkey, replace(replace({MODELS}, 'ViT-B/', 'ViT-B-'), 'ViT-L/', 'ViT-L-') AS model FROM part")
def p40_model_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.model_name(F.expr(MODELS)).alias("model"))


@query("SELECT p_partkey, ((p_size * 10 + 5)::BIGINT * CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 100000 ELSE 100000000 END)::BIGINT AS bytes FROM part")
def s20_source_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.size_bytes(F.expr(SIZES)).alias("bytes"))


@query(rf"SELECT p_partkey, coalesce(nullif(regexp_extract({NAMES}, '\(([^)]+)\)$', 1), ''), {NAMES}) AS dataset FROM part")
def j07_dataset_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.short_name(F.expr(NAMES)).alias("dataset"))


@query("SELECT user_id, s.kind AS event_type, s.v AS value FROM (SELECT user_id, arg_min({'kind': event_type, 'v': value}, event_id) AS s FROM events GROUP BY user_id)")
def a04_first_rows(spark, sf_dir):
    first = F.min_by(F.struct("event_type", "value"), "event_id").alias("s")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first).select("user_id", "s.event_type", "s.value")


@query(f"WITH {FRAMES_SQL} SELECT clip, frame, CASE WHEN class_name IN ('click', 'view') THEN 'interaction' ELSE class_name END AS class_name, sum(cents)::BIGINT AS cents FROM frames GROUP BY ALL")
def a07_class_sums(spark, sf_dir):
    named = scores.canonical_class(F.col("class_name"), {"click": "interaction", "view": "interaction"})
    return records.class_sums(surveys.frames(spark, sf_dir), named, ["clip", "frame"]).select("clip", "frame", "class_name", "cents")


GROUPS = {"seen": ["view", "click"], "done": ["purchase", "signup"], "fine": ["view", "click", "purchase"]}


@query(f"WITH {FRAMES_SQL} SELECT clip, group_name, coalesce(sum(cents) FILTER (list_contains(members, class_name)), 0)::BIGINT AS cents FROM frames, (VALUES "
       + ", ".join(f"('{g}', {m})" for g, m in GROUPS.items()) + ") t(group_name, members) GROUP BY clip, group_name")
def a09_group_sums(spark, sf_dir):
    return records.group_sums(surveys.frames(spark, sf_dir), GROUPS)


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def a12_invalid_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderpriority").alias("value")).distinct()


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def a13_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type IS NOT NULL").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


RECORDS = """SELECT event_id AS row_key, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE concat('f', event_id % 900) END AS feature_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('c', user_id) END AS clip_id,
CASE event_type WHEN 'view' THEN 'visual_semantic_summary' WHEN 'click' THEN 'visual_clip_embedding' WHEN 'error' THEN 'mystery' ELSE 'other' END AS feature_type,
CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{"tool":"x"}' WHEN 2 THEN '[1]' WHEN 3 THEN '{broken' END AS provenance_json,
CASE event_id % 13 WHEN 0 THEN concat('{"class_ratio":{"sky":0.5,"road":', event_id % 3, '},"sampled_frame_count":3,"frame_sampling_rule":"all"}') WHEN 1 THEN '{"class_ratio":{},"sampled_frame_count":2.5,"frame_sampling_rule":null}'
WHEN 2 THEN '7' WHEN 3 THEN '{"class_ratio":[1],"sampled_frame_count":0.5,"frame_sampling_rule":" "}' WHEN 4 THEN '{"class_ratio":{"sky":"0.5","sea":"much","tree":true,"road":null},"sampled_frame_count":"2.5"}'
WHEN 5 THEN '{"class_ratio":{"sky":1},"sampled_frame_count":" 4 ","frame_sampling_rule":"all","grouped_categories":[0.5]}' WHEN 6 THEN '{"class_ratio":{"sky":1},"sampled_frame_count":true,"frame_sampling_rule":2,"grouped_categories":{"nature":1.5,"built":0}}'
WHEN 7 THEN '{"class_ratio":{"sky":1},"sampled_frame_count":-3,"frame_sampling_rule":"all","grouped_categories":null,"status":"Placeholder"}' WHEN 8 THEN '{"class_ratio":{"sky":1},"sampled_frame_count":null,"frame_sampling_rule":"all"}' WHEN 9 THEN '' WHEN 10 THEN '{broken' WHEN 11 THEN ' ' END AS feature_value_json,
CASE WHEN event_id % 13 IN (9, 11) THEN '{"class_ratio":{"sky":2},"sampled_frame_count":1,"frame_sampling_rule":"all"}' END AS feature_json,
CASE WHEN event_id % 3 = 0 THEN concat('features/', event_id % 1000, '.npy') END AS feature_path, CASE WHEN event_id % 4 = 0 THEN 'a PLACEHOLDER row' END AS notes FROM events"""
TYPES = ("visual_semantic_summary", "visual_clip_embedding", "other")


def _summaries(rule: str, parts: dict[int, list[str]]) -> str:
    """SQL for findings that the summaries of some remainders of the row key must give."""
    values = ", ".join(f"({k}, '{p}')" for k, named in parts.items() for p in named)
    return f" UNION ALL SELECT row_key, '{rule}', part FROM r JOIN (VALUES {values}) v(k, part) ON row_key % 13 = k WHERE summary"


_RECORD_SQL = f"""WITH r AS (SELECT *, feature_type = 'visual_semantic_summary' AS summary FROM ({RECORDS})),
firsts AS (SELECT feature_id, min(row_key) AS first FROM r WHERE trim(feature_id) <> '' GROUP BY feature_id)
SELECT row_key, 'F01' AS rule, 'feature_id' AS part FROM r WHERE trim(coalesce(feature_id, '')) = ''
UNION ALL SELECT row_key, 'F02', feature_id FROM r JOIN firsts USING (feature_id) WHERE row_key > first
UNION ALL SELECT row_key, 'F03', 'clip_id' FROM r WHERE trim(coalesce(clip_id, '')) = ''
UNION ALL SELECT row_key, 'F04', clip_id FROM r WHERE trim(coalesce(clip_id, '')) <> '' AND clip_id NOT IN (SELECT concat('c', user_id) FROM events WHERE user_id % 7 <> 0)
UNION ALL SELECT row_key, 'F05', feature_type FROM r WHERE feature_type NOT IN {TYPES}
UNION ALL SELECT row_key, 'F06', 'provenance_json' FROM r WHERE trim(coalesce(provenance_json, '')) = ''
UNION ALL SELECT row_key, 'F07', 'provenance_json' FROM r WHERE trim(provenance_json) <> '' AND NOT json_valid(provenance_json)
UNION ALL SELECT row_key, 'F08', 'provenance_json' FROM r WHERE CASE WHEN json_valid(provenance_json) THEN json_type(provenance_json) <> 'OBJECT' ELSE false END
UNION ALL SELECT row_key, 'F09', 'feature_value_json' FROM r WHERE row_key % 13 IN (2, 10)
UNION ALL SELECT row_key, 'F10', feature_path FROM r WHERE feature_path IS NOT NULL AND row_key % 4 <> 0 AND row_key % 13 <> 7 AND feature_path NOT IN (SELECT concat('features/', p_partkey, '.npy') FROM part)
UNION ALL SELECT row_key, 'F11', 'feature_value_json' FROM r WHERE summary AND row_key % 13 IN (2, 10, 11, 12)
UNION ALL SELECT row_key, 'F13', 'road' FROM r WHERE summary AND row_key % 13 = 0 AND row_key % 3 = 2""" + _summaries("F12", {1: ["class_ratio"], 3: ["class_ratio"]}) + _summaries("F13", {4: ["sea", "road"], 9: ["sky"]}) + _summaries("F14", {6: ["nature"]}) + _summaries("F14_object", {5: ["grouped_categories"]}) + _summaries("F15_integer", {4: ["sampled_frame_count"], 8: ["sampled_frame_count"]}) + _summaries("F15_positive", {3: ["sampled_frame_count"], 7: ["sampled_frame_count"]}) + _summaries("F16", {3: ["frame_sampling_rule"], 4: ["frame_sampling_rule"]})


def feature_rows(spark, sf_dir):
    return spark.sql(RECORDS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def feature_clips(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("user_id % 7 <> 0").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("clip_id"))


@query(_RECORD_SQL)
def b11_record_findings(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("features/"), F.col("p_partkey").cast("string"), F.lit(".npy")).alias("path"))
    return records.record_findings(feature_rows(spark, sf_dir), feature_clips(spark, sf_dir), TYPES, files)


#: Spellings of shares, and whether they are numbers of 0 to 1.
SHARES = [("0.5", True), ("0.5d", False), ("0x1p-1", False), (" 0.5 ", True), ("1_0e-1", True), ("1__0e-1", False), ("1f", False), ("inf", False), ("nan", False), ("1.", True), (".5", True), ("", False), ("1.5", False), ("5e-1", True)]


@query(f"SELECT event_id AS row_key, 'F13' AS rule, 'x' || (event_id % {len(SHARES)}) AS part FROM events WHERE event_id % {len(SHARES)} IN ({', '.join(str(i) for i, (_, fine) in enumerate(SHARES) if not fine)})")
def f13_spelled_shares(spark, sf_dir):
    """Shares as texts: what spells a number elsewhere in the library, and no more."""
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(SHARES))
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS row_key", f"concat('{{\"class_ratio\":{{\"x', event_id % {len(SHARES)}, '\":\"', CASE event_id % {len(SHARES)} {cases} END, '\"}},\"sampled_frame_count\":1,\"frame_sampling_rule\":\"all\"}}') AS feature_value_json")
    whole = rows.select("row_key", F.concat(F.lit("f"), F.col("row_key").cast("string")).alias("feature_id"), F.lit("c").alias("clip_id"), F.lit("visual_semantic_summary").alias("feature_type"), F.lit("{}").alias("provenance_json"), "feature_value_json")
    return records.record_findings(whole, spark.createDataFrame([("c",)], "clip_id string"), TYPES)


_WIDE_SQL = f"""r AS ({RECORDS}), c AS (SELECT DISTINCT concat('c', user_id) AS clip_id FROM events WHERE user_id % 7 <> 0),
issues AS (SELECT 'F18' AS rule, string_agg(feature_id, ',' ORDER BY feature_id) AS detail FROM (SELECT feature_id FROM r WHERE feature_id IS NOT NULL GROUP BY feature_id HAVING count(*) > 1 ORDER BY feature_id LIMIT 10) HAVING count(*) > 0
UNION ALL SELECT 'F19', string_agg(coalesce(clip_id, 'nan'), ',' ORDER BY row_key) FROM (SELECT row_key, clip_id FROM r WHERE clip_id IS NULL OR clip_id NOT IN (SELECT clip_id FROM c) ORDER BY row_key LIMIT 10) HAVING count(*) > 0
UNION ALL SELECT 'F20', string_agg(feature_type, ',' ORDER BY feature_type) FROM (SELECT DISTINCT feature_type FROM r WHERE feature_type NOT IN {records.WIDE_TYPES}) HAVING count(*) > 0
UNION ALL SELECT 'F21', concat('row ', row_key + 1, ': ', fault) FROM (SELECT row_key, CASE WHEN provenance_json IS NULL THEN 'empty' WHEN NOT json_valid(provenance_json) THEN 'no JSON' WHEN CASE WHEN json_valid(provenance_json) THEN json_type(provenance_json) <> 'OBJECT' ELSE false END THEN 'no object' END AS fault FROM r) WHERE fault IS NOT NULL)"""


@query(f"WITH {_WIDE_SQL} SELECT * FROM issues")
def b12_wide_report(spark, sf_dir):
    """Rules F17 to F21 (and A11, A12, W06 in them)."""
    return records.wide_report(feature_rows(spark, sf_dir), feature_clips(spark, sf_dir), records.WIDE_TYPES)


@query(f"WITH {_WIDE_SQL} SELECT (SELECT count(*) FROM events WHERE user_id % 7 <> 0) AS clips, (SELECT count(*) FROM events) AS records, (SELECT count(*) FROM issues) AS issues, CASE WHEN EXISTS (FROM issues) THEN 'FAIL' ELSE 'PASS' END AS status")
def f22_report_summary(spark, sf_dir):
    rows, clips = feature_rows(spark, sf_dir), feature_clips(spark, sf_dir)
    return records.report_summary(rows, clips, records.wide_report(rows, clips, records.WIDE_TYPES))


@query(f"WITH {PLACES_SQL} SELECT response_key, to_json({{'place': {{'location': location, 'session': session}}, 'grp': grp}})::VARCHAR AS study FROM places")
def h01_nested_records(spark, sf_dir):
    spec = [("response_key", "sample_id"), ("location", "study.place.location"), ("session", "study.place.session"), ("grp", "study.grp")]
    rows = surveys.place_responses(spark, sf_dir).select(*harmonise.nested(spec))
    return rows.select(F.col("sample_id").alias("response_key"), F.to_json("study", {"ignoreNullFields": "false"}).alias("study"))


@query(f"WITH {STIMULUS_SQL} " + " UNION ALL ".join(f"SELECT response_key, line, part_key, '{i}' AS field, 'not_reported' AS status, 'no answer' AS reason FROM stimulus WHERE {i} IS NULL" for i in ITEMS))
def h02_missingness(spark, sf_dir):
    rows = surveys.stimulus_responses(spark, sf_dir)
    found = harmonise.missingness([(i, "not_reported", "no answer") for i in ITEMS])
    return rows.select("response_key", "line", "part_key", F.explode(found).alias("m")).select("response_key", "line", "part_key", "m.*")


@query(f"WITH {PLACES_SQL} " + " UNION ALL ".join(f"SELECT response_key, '{i}' AS item, {i} AS value FROM places" for i in ITEMS))
def h10_long_items(spark, sf_dir):
    return harmonise.long_items(surveys.place_responses(spark, sf_dir), ["response_key"], ITEMS)


LINKS = [("Order", "l_orderkey", "contains", "Part", "l_partkey"), ("Supplier", "l_suppkey", "supplies", "Part", "l_partkey")]


@query("SELECT DISTINCT 'Order:' || l_orderkey AS id, 'Order' AS type FROM lineitem UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'Part' FROM lineitem UNION ALL SELECT DISTINCT 'Supplier:' || l_suppkey, 'Supplier' FROM lineitem")
def h06_graph_nodes(spark, sf_dir):
    return harmonise.graph(table(spark, sf_dir, "lineitem"), LINKS)[0]


@query("SELECT DISTINCT 'Order:' || l_orderkey AS source, 'contains' AS relation, 'Part:' || l_partkey AS target FROM lineitem UNION ALL SELECT DISTINCT 'Supplier:' || l_suppkey, 'supplies', 'Part:' || l_partkey FROM lineitem")
def h06_graph_edges(spark, sf_dir):
    return harmonise.graph(table(spark, sf_dir, "lineitem"), LINKS)[1]


@query("SELECT DISTINCT 'Order:' || l_orderkey AS source, 'contains' AS relation, 'Part:' || l_partkey AS target, 'target' AS side FROM lineitem WHERE l_partkey % 9 = 0 UNION ALL SELECT DISTINCT 'Supplier:' || l_suppkey, 'supplies', 'Part:' || l_partkey, 'target' FROM lineitem WHERE l_partkey % 9 = 0")
def j08_loose_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    nodes = harmonise.graph(rows, LINKS)[0]
    kept = nodes.filter("type <> 'Part' OR cast(substring(id, 6) AS bigint) % 9 <> 0")
    return harmonise.loose_edges(kept, harmonise.graph(rows, LINKS)[1])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 0)")
def j10_uncovered(spark, sf_dir):
    """Customers are targets, orders of some of them a spec that leaves out every seventh."""
    mapped = table(spark, sf_dir, "orders").filter("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    return harmonise.uncovered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), mapped, "c_custkey")


@query(f"WITH {PLACES_SQL}, {STIMULUS_SQL} SELECT 'places' AS dataset_id, response_key, location, session, NULL::VARCHAR AS masker, pleasant FROM places UNION ALL SELECT 'stimuli', response_key, NULL, NULL, masker, pleasant FROM stimulus")
def u07_stacked(spark, sf_dir):
    places = surveys.place_responses(spark, sf_dir).select(F.lit("places").alias("dataset_id"), "response_key", "location", "session", "pleasant")
    stimuli = surveys.stimulus_responses(spark, sf_dir).select(F.lit("stimuli").alias("dataset_id"), "response_key", "masker", "pleasant")
    return places.unionByName(stimuli, allowMissingColumns=True)


@query("SELECT l_orderkey AS sample_id, l_linenumber::BIGINT AS rating, l_quantity AS value, l_returnflag AS language FROM lineitem")
def b08_flattened_records(spark, sf_dir):
    """JSON documents of an order and its lines, parsed and flattened to a row for each line."""
    lines = F.collect_list(F.struct(F.col("l_linenumber").alias("rating"), F.col("l_quantity").alias("value"), F.struct(F.col("l_returnflag").alias("language")).alias("participant")))
    documents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(lines.alias("ratings")).select(F.to_json(F.struct("sample_id", "ratings")).alias("value"))
    parsed = documents.select(F.from_json("value", "sample_id long, ratings array<struct<rating: long, value: double, participant: struct<language: string>>>").alias("r"))
    return parsed.select("r.sample_id", F.explode("r.ratings").alias("x")).select("sample_id", "x.rating", "x.value", "x.participant.language")
