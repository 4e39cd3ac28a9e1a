"""Queries of nested clip records, built as JSON text from orders, with absent and null parts and broken texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import nested
from earshot.operators.tables import dealt
from earshot.plans.base import query
from earshot.sources.surveys import table

RECORDS = """SELECT o_orderkey AS row_key, CASE o_orderkey % 13 WHEN 0 THEN '{broken' WHEN 1 THEN '[]' ELSE concat('{"clip_id":"C', o_orderkey, '","dataset_id":"D"', CASE o_orderkey % 13 WHEN 2 THEN '' ELSE ',"licence":{"spdx":"CC-BY-4.0"}' END,
',"grouping":{"LocationID":"L', o_custkey % 9, '","SessionID":', CASE o_orderkey % 13 WHEN 3 THEN 'null' ELSE '"S1"' END, ',"GroupID":', o_custkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN ',"latitude":51.5' ELSE '' END, '},"segment":{"binaural_start_s":0,"binaural_end_s":30.5}',
',"assets":{"binaural_wav":"a.wav"', CASE WHEN o_orderkey % 3 = 0 THEN ',"video_360":"v.mp4"' ELSE '' END, '},"perceptual_summary":{"n_responses":2,"mean_PAQs":{"pleasant":', o_custkey % 5 + 1, CASE WHEN o_orderkey % 4 = 0 THEN ',"calm":null' ELSE ',"calm":2.5' END, '},"mean_ISOPleasant":0.25,"mean_ISOEventful":-0.5}',
',"psychoacoustic":{"LAeq_dBA":', o_custkey % 60, '.5}', CASE o_orderkey % 13 WHEN 4 THEN '' ELSE concat(',"perceptual_ratings":[{"response_id":"R1","participant_id":"P', o_custkey % 50, '","PAQs":{"calm":', o_custkey % 5 + 1, '},"demographics":{"age":', o_custkey % 60 + 18, '}},{"response_id":"R2","participant_id":"P0","language":"en","PAQs":null,"derived_circumplex":{"ISOPleasant":0.5,"ISOEventful":0.125}}]') END, '}') END AS value FROM orders"""


def _docs(spark, sf_dir):
    return spark.sql(RECORDS.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")))


_KEPT = "FROM orders WHERE o_orderkey % 13 NOT IN (0, 1, 2, 4)"


@query(f"SELECT 'C' || o_orderkey AS clip_id, 'D' AS dataset_id, 'L' || o_custkey % 9 AS location_id, CASE WHEN o_orderkey % 13 <> 3 THEN 'S1' END AS session_id, (o_custkey % 7)::VARCHAR AS group_id, 0::DOUBLE AS start_s, 30.5::DOUBLE AS end_s, 'a.wav' AS audio_asset, 'CC-BY-4.0' AS licence_spdx, 2::DOUBLE AS n_responses, CASE WHEN o_orderkey % 2 = 0 THEN 51.5 END::DOUBLE AS latitude, CASE WHEN o_orderkey % 3 = 0 THEN 'v.mp4' END AS video_asset, (o_custkey % 5 + 1)::DOUBLE AS mean_pleasant, CASE WHEN o_orderkey % 4 <> 0 THEN 2.5 END::DOUBLE AS mean_calm, (o_custkey % 60 + 0.5)::DOUBLE AS LAeq_dBA, NULL::DOUBLE AS tonality_T_tu {_KEPT}")
def b08_flattened_clips(spark, sf_dir):
    """Nested records as clip rows."""
    clips = nested.clips_of(_docs(spark, sf_dir))
    return clips.select("clip_id", "dataset_id", "location_id", "session_id", "group_id", "start_s", "end_s", "audio_asset", "licence_spdx", "n_responses", "latitude", "video_asset", "mean_pleasant", "mean_calm", "LAeq_dBA", "tonality_T_tu")


@query(f"SELECT 'C' || o_orderkey AS clip_id, 'R1' AS response_id, 'P' || o_custkey % 50 AS participant_id, NULL::VARCHAR AS language, (o_custkey % 5 + 1)::DOUBLE AS calm, NULL::DOUBLE AS iso_pleasant, (o_custkey % 60 + 18)::DOUBLE AS age {_KEPT} UNION ALL SELECT 'C' || o_orderkey, 'R2', 'P0', 'en', NULL, 0.5, NULL {_KEPT}")
def b08_flattened_ratings(spark, sf_dir):
    """The ratings of nested records as rows, absent parts null."""
    return nested.ratings_of(_docs(spark, sf_dir)).select("clip_id", "response_id", "participant_id", "language", "calm", "iso_pleasant", "age")


@query("SELECT o_orderkey AS row_key, o_orderkey::VARCHAR AS record_id, 'error' AS severity, rule, part FROM orders JOIN (VALUES (0, 'JSON', 'record'), (1, 'JSON', 'record'), (2, 'required', 'licence.spdx'), (4, 'required', 'perceptual_ratings')) f(k, rule, part) ON o_orderkey % 13 = k")
def p33_lost_paths(spark, sf_dir):
    """Required paths that nested records lack."""
    return nested.lost_paths(_docs(spark, sf_dir))
