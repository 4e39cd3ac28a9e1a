"""Nested clip records flattened to a row for each clip and a row for each of its ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.scores import ITEMS
from earshot.operators.samples import broken, entries, exploded, is_object

# Paths of clip columns that must be there, of those that may, and psychoacoustic columns.
REQUIRED = {"clip_id": "clip_id", "dataset_id": "dataset_id", "location_id": "grouping.LocationID", "session_id": "grouping.SessionID", "group_id": "grouping.GroupID", "start_s": "segment.binaural_start_s", "end_s": "segment.binaural_end_s",
            "audio_asset": "assets.binaural_wav", "licence_spdx": "licence.spdx", "n_responses": "perceptual_summary.n_responses", "iso_pleasant": "perceptual_summary.mean_ISOPleasant", "iso_eventful": "perceptual_summary.mean_ISOEventful"}
OPTIONAL = {"latitude": "grouping.latitude", "longitude": "grouping.longitude", "video_asset": "assets.video_360", "split": "split"}
INDICATORS = ("LAeq_dBA", "loudness_N_sone", "sharpness_S_acum", "roughness_R_asper", "fluctuation_strength_F_vacil", "tonality_T_tu")
NUMBERS = ("start_s", "end_s", "n_responses", "iso_pleasant", "iso_eventful", "latitude", "longitude")
SECTIONS = ("psychoacoustic", "perceptual_ratings")


def at(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, f"$.{path}", kind)


def lost_paths(docs: DataFrame) -> DataFrame:
    """Findings of docs(row_key, value): texts that are no JSON object, and required paths that are absent (a null is not)."""
    doc = docs.select("row_key", F.col("row_key").cast("string").alias("record_id"), F.try_parse_json("value").alias("_doc"))
    whole = is_object(F.col("_doc"))
    paths = [*REQUIRED.values(), *SECTIONS]
    rules = [("JSON", "error", broken(~whole, "record"))] + [("required", "error", broken(whole & at(F.col("_doc"), p).isNull(), p)) for p in paths]
    return exploded(doc, rules)


def sound(docs: DataFrame) -> DataFrame:
    """The variants _doc of docs that have all required paths. They are exploded out of a list of one, as a filter of a plain
    column would move below it and parse the text once for each path."""
    doc = F.col("_doc")
    there = reduce(Column.__and__, [at(doc, p).isNotNull() for p in (*REQUIRED.values(), *SECTIONS)], is_object(doc))
    return docs.select(F.explode(F.array(F.try_parse_json("value"))).alias("_doc")).filter(there)


def typed(doc: Column, name: str, path: str) -> Column:
    return at(doc, path, "double" if name in NUMBERS else "string").alias(name)


def clips_of(docs: DataFrame) -> DataFrame:
    """One row for each sound record: its columns, mean items (mean_<item>) and indicators; what is absent is null."""
    doc = F.col("_doc")
    fields = [typed(doc, name, path) for name, path in (REQUIRED | OPTIONAL).items()]
    means = [at(doc, f"perceptual_summary.mean_PAQs.{i}", "double").alias(f"mean_{i}") for i in ITEMS]
    return sound(docs).select(*fields, *means, *[at(doc, f"psychoacoustic.{i}", "double").alias(i) for i in INDICATORS])


def ratings_of(docs: DataFrame) -> DataFrame:
    """One row for each rating of sound records, with its clip; absent items, coordinates and people are null."""
    doc, r = F.col("_doc"), F.col("_r")
    rows = sound(docs).select(at(doc, "clip_id", "string").alias("clip_id"), F.explode(entries(at(doc, "perceptual_ratings"))).alias("_r"))
    texts = [at(r, c, "string").alias(c) for c in ("response_id", "participant_id", "language")]
    return rows.select("clip_id", *texts, *[at(r, f"PAQs.{i}", "double").alias(i) for i in ITEMS], at(r, "derived_circumplex.ISOPleasant", "double").alias("iso_pleasant"), at(r, "derived_circumplex.ISOEventful", "double").alias("iso_eventful"),
                       at(r, "demographics.age", "double").alias("age"), at(r, "demographics.gender", "string").alias("gender"))
