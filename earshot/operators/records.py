"""Feature records: class shares, JSON payloads, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import texts
from earshot.operators.samples import broken, each, given, is_object, kind_is, members, no_parts, part, plain

# Record types of the strict profile.
STRICT_TYPES = ("audio_embedding", "visual_clip_embedding", "visual_semantic_summary", "behavioural_attention", "contextual_descriptor", "other")
# Record types of the wide profile.
WIDE_TYPES = ("psychoacoustic", "audio_embedding", "visual_clip_embedding", "visual_semantic_summary", "text_caption", "behavioural_attention", "contextual_descriptor", "caption_or_prompt_descriptor", "other")


def class_sums(frames: DataFrame, named: Column, keys: list[str]) -> DataFrame:
    """Shares (whole cents) added up by the class that `named` gives; names that fall together are one class."""
    return frames.withColumn("class_name", named).groupBy(*keys, "class_name").agg(F.sum("cents").alias("cents"))


def group_sums(totals: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """clip, group_name, cents for every clip and group: the sum of member classes, 0 if none is there.

    Groups may overlap. They are a literal of the plan, so that totals are read once and summed per clip alone.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("class_name").isin(*members), F.col("cents"))), F.lit(0)).alias(name) for name, members in groups.items()]
    wide = totals.groupBy("clip").agg(*sums)
    return wide.unpivot("clip", list(groups), "group_name", "cents")


def payload(**fields: Column) -> Column:
    """A JSON object of fields in the given order, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def bad_share(v: Column) -> Column:
    """Whether a value is outside 0 to 1, or spells no number; truth values are 0 and 1."""
    return ~(kind_is(v, "BOOLEAN") | F.coalesce(texts.number(plain(v)).between(0.0, 1.0), F.lit(False)))


def named_shares(v: Column) -> Column:
    return each(F.map_entries(members(v)), lambda e: bad_share(e["value"]), lambda e: e["key"])


def whole(v: Column) -> Column:
    """The whole number of a value: numbers are cut towards zero, texts must spell one; null for anything else."""
    number = F.when(kind_is(v, "BOOLEAN"), F.when(plain(v) == "true", 1.0).otherwise(0.0)).when(kind_is(v, "STRING"), F.when(plain(v).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(plain(v)).try_cast("double")))
    return number_or(number, F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), plain(v).try_cast("double")))


def number_or(a: Column, b: Column) -> Column:
    found = F.coalesce(a, b)
    return F.when(found >= 0, F.floor(found)).otherwise(F.ceil(found))


def record_findings(records: DataFrame, clips: DataFrame, types: tuple[str, ...], files: DataFrame | None = None, folder: str = "") -> DataFrame:
    """row_key, rule and part of every rule that a row of records breaks.

    records has row_key, feature_id, clip_id, feature_type, provenance_json and feature_value_json, and may have
    feature_json (read where the latter is empty), feature_path and notes; clips has clip_id, files the paths that are
    there (path; without it, files are not checked), and feature_path is below folder unless it is absolute. All rules but the unknown clip, the repeated id and the missing
    file are one pass over the rows, which parses each JSON text once. Of rows that share an id, all but the one of
    the smallest row_key are findings: minima are pre-aggregated, so a hot id is no large group. Null cells are blank;
    an empty table gives no findings. JSON with NaN or repeated keys counts as no JSON.
    """
    raw = {c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("") for c in ("feature_id", "clip_id", "feature_type", "provenance_json", "feature_value_json", "feature_json", "feature_path", "notes")}
    text = {c: F.trim(x) for c, x in raw.items()}
    # of the two columns the first that is not empty is read, even where it holds nothing but spaces
    value_text = F.when(raw["feature_value_json"] != "", text["feature_value_json"]).otherwise(text["feature_json"])
    rows = records.select("row_key", *[x.alias(c) for c, x in text.items()], value_text.alias("_text"))
    rows = rows.withColumn("_value", F.try_parse_json("_text")).withColumn("_prov", F.try_parse_json("provenance_json"))
    value = F.col("_value")
    rows = rows.withColumn("_sound", is_object(value)).withColumn("_count", whole(part(value, "sampled_frame_count")))
    sound = F.col("_sound") & (F.col("feature_type") == "visual_semantic_summary")
    ratio, groups, rule = part(value, "class_ratio"), part(value, "grouped_categories"), part(value, "frame_sampling_rule")
    whole_ratio = is_object(ratio) & given(ratio)
    some = lambda cond, parts: F.when(cond, parts).otherwise(no_parts())
    rules = {
        "F01": broken(F.col("feature_id") == "", "feature_id"),
        "F03": broken(F.col("clip_id") == "", "clip_id"),
        "F05": broken(~F.col("feature_type").isin(*types), F.col("feature_type")),
        "F06": broken(F.col("provenance_json") == "", "provenance_json"),
        "F07": broken((F.col("provenance_json") != "") & F.col("_prov").isNull(), "provenance_json"),
        "F08": broken(F.col("_prov").isNotNull() & ~is_object(F.col("_prov")), "provenance_json"),
        "F09": broken((F.col("_text") != "") & ~F.col("_sound"), "feature_value_json"),
        "F11": broken((F.col("feature_type") == "visual_semantic_summary") & ~F.col("_sound"), "feature_value_json"),
        "F12": broken(sound & ~whole_ratio, "class_ratio"),
        "F13": some(sound & whole_ratio, named_shares(ratio)),
        "F14_object": broken(sound & plain(groups).isNotNull() & ~is_object(groups), "grouped_categories"),
        "F14": some(sound, named_shares(groups)),
        "F15_integer": broken(sound & F.col("_count").isNull(), "sampled_frame_count"),
        "F15_positive": broken(sound & (F.col("_count") <= 0), "sampled_frame_count"),
        "F16": broken(sound & (rule.isNull() | (kind_is(rule, "STRING") & (F.trim(plain(rule)) == ""))), "frame_sampling_rule"),
    }
    marked = [with_rule(name, parts) for name, parts in rules.items()]
    own = rows.select("row_key", F.explode(F.flatten(F.array(*marked))).alias("f")).select("row_key", "f.rule", "f.part")
    firsts = rows.filter("feature_id <> ''").groupBy("feature_id").agg(F.min("row_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = rows.select("row_key", "feature_id").join(firsts, "feature_id").filter("row_key > first").select("row_key", F.lit("F02").alias("rule"), F.col("feature_id").alias("part"))
    known = clips.select("clip_id").filter("clip_id <> ''").distinct()
    unknown = rows.filter("clip_id <> ''").select("row_key", "clip_id").join(known, "clip_id", "left_anti").select("row_key", F.lit("F04").alias("rule"), F.col("clip_id").alias("part"))
    out = own.unionByName(later).unionByName(unknown)
    if files is not None:
        placeholder = F.lower("notes").contains("placeholder") | (F.col("_sound") & F.lower(F.coalesce(plain(part(value, "status")), F.lit(""))).contains("placeholder"))
        place = F.when(F.col("feature_path").startswith("/") | F.lit(not folder), F.col("feature_path")).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/"), "feature_path"))
        wanted = rows.filter((F.col("feature_path") != "") & ~placeholder).select("row_key", "feature_path", place.alias("path"))
        out = out.unionByName(wanted.join(files.select("path").distinct(), "path", "left_anti").select("row_key", F.lit("F10").alias("rule"), F.col("feature_path").alias("part")))
    return out


def with_rule(rule: str, parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.lit(rule).alias("rule"), p.alias("part")))


#: Rows that a report names.
REPORTED = 10


def wide_report(records: DataFrame, clips: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """rule and detail of every issue of the wide profile of records(row_key, ...): missing columns, up to REPORTED
    repeated ids and REPORTED clips that are unknown (a missing clip is one, and reads nan), types that are none of
    `types`, and each row whose provenance is empty, no JSON or no object, by its number in the file (row_key + 1, for
    the header). Ids and types are in order; unknown clips in that of their rows.
    """
    spark, issues = records.sparkSession, []
    wanted = ("feature_id", "clip_id", "feature_type", "provenance_json")
    gone = [c for c in wanted if c not in records.columns]
    if gone:
        issues.append(spark.createDataFrame([("F17", c) for c in gone], "rule string, detail string"))
    if "feature_id" not in gone:
        twice = records.filter("feature_id IS NOT NULL").groupBy("feature_id").count().filter("count > 1").orderBy("feature_id").limit(REPORTED)
        issues.append(twice.agg(F.array_join(F.sort_array(F.collect_list("feature_id")), ",").alias("detail")).filter("detail <> ''").select(F.lit("F18").alias("rule"), "detail"))
    if "clip_id" not in gone:
        lost = records.join(clips.select("clip_id").filter("clip_id IS NOT NULL").distinct(), "clip_id", "left_anti").select("row_key", F.coalesce("clip_id", F.lit("nan")).alias("clip_id"))
        first = lost.orderBy("row_key").limit(REPORTED)
        issues.append(first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_key", "clip_id"))), lambda x: x["clip_id"]), ",").alias("detail")).filter("detail <> ''").select(F.lit("F19").alias("rule"), "detail"))
    if "feature_type" not in gone:
        bad = records.filter(~F.col("feature_type").isin(*types)).select("feature_type").distinct()
        issues.append(bad.agg(F.array_join(F.sort_array(F.collect_list("feature_type")), ",").alias("detail")).filter("detail <> ''").select(F.lit("F20").alias("rule"), "detail"))
    if "provenance_json" not in gone:
        doc = F.try_parse_json("provenance_json")
        fault = F.when(F.col("provenance_json").isNull(), "empty").when(doc.isNull(), "no JSON").when(~is_object(doc), "no object")
        issues.append(records.select((F.col("row_key") + 1).alias("n"), fault.alias("fault")).filter("fault IS NOT NULL").select(F.lit("F21").alias("rule"), F.concat(F.lit("row "), F.col("n").cast("string"), F.lit(": "), F.col("fault")).alias("detail")))
    return reduce(DataFrame.unionByName, issues)


def report_summary(records: DataFrame, clips: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: clips, records, issues and status (PASS or FAIL)."""
    parts = {"clips": clips, "records": records, "issues": issues}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()])
    joined = counts.agg(*[F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])
    return joined.withColumn("status", F.when(F.col("issues") == 0, "PASS").otherwise("FAIL"))
