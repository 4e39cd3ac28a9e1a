"""Queries of the dataset catalogue over JSON texts built from parts, and SQL that reads the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import catalogue
from earshot.operators.tables import dealt
from earshot.plans.base import query
from earshot.sources.surveys import table

CATALOGUE = """SELECT concat('{"set ', p_partkey, '":{"Description":', CASE p_partkey % 7 WHEN 0 THEN '"Shared under CC BY-NC-SA."' WHEN 1 THEN '"CC BY-NC data"' WHEN 2 THEN '"cc by-sa"' WHEN 3 THEN '"CC BY 4.0"' WHEN 4 THEN 'null' WHEN 5 THEN '""' ELSE '"ask us"' END,
',"Year":', 2000 + p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"Scenario":"urban"' END, ',"Link":', CASE p_partkey % 3 WHEN 0 THEN '"no available link"' WHEN 1 THEN 'null' ELSE concat('"https://example.org/', p_partkey, '"') END,
',"Access":', CASE p_partkey % 4 WHEN 0 THEN '"Partilally"' WHEN 1 THEN '"Yes"' ELSE 'null' END,
',"Sample Size":{', CASE p_partkey % 4 WHEN 0 THEN '"Audio Samples":0,"Audio Recording":12,' WHEN 1 THEN '"Audio Samples":7,"Audio Recording":12,' WHEN 2 THEN '"Audio Recording":null,' ELSE '' END, '"Participants":', p_size, ',"Duration(mins)":', p_size, '.5}',
',"Recording":{"Audio":', CASE p_partkey % 5 WHEN 0 THEN '{"Ambisonics":null,"Monaural":{"Duration":"15 mins"}}' WHEN 1 THEN concat('{"Ambisonics":{"Bit Depth":"24 or 32","Sampling Rate":48000,"Order":1,"Duration":"', p_size, 's"}}')
WHEN 2 THEN '{"Binaural":{"Bit Depth":24.7,"Sampling Rate":44100,"Duration":0,"Duration(s)":"30 s"}}' WHEN 3 THEN '{"Binaural":{"Duration":"1 hour"},"Ambisonics":{"Duration":12.5}}' ELSE 'null' END,
',"Visual":', CASE p_partkey % 6 WHEN 0 THEN '"360 video"' WHEN 1 THEN '{"Format":"Image set","Resolution":" 4K ","Frame Rate":30,"Duration":"2 min"}' WHEN 2 THEN 'null' WHEN 3 THEN '{}' WHEN 4 THEN '{"Format":"mixed media","Duration":12.5}' ELSE '"Video"' END,
'},"Emotional Annotation":{"Assessment Framework":"', p_brand, '","Experimental Setting":', CASE p_partkey % 8 WHEN 0 THEN '"on site"' WHEN 1 THEN '"VR room"' WHEN 2 THEN '"Online"' WHEN 3 THEN '"online survey"' WHEN 4 THEN '"mixed"' WHEN 5 THEN 'null' WHEN 6 THEN '"LAB"' ELSE '""' END,
'}', CASE p_partkey % 3 WHEN 0 THEN ',"Acoustic Data":{"Measuring Instrument":"meter"}' WHEN 1 THEN ',"Acoustic Data":null,"Environmental Data":{}' ELSE '' END, '}}') AS value FROM part"""


def _seconds(v: str, kind: str) -> str:
    low = f"lower({v})"
    unit = f"CASE WHEN {low} LIKE '%hour%' THEN 3600 WHEN {low} LIKE '%min%' THEN 60 ELSE 1 END"
    return f"CASE WHEN {kind} = 'VARCHAR' THEN try_cast(nullif(regexp_extract({v}, '([0-9.]+)', 1), '') AS DOUBLE) * {unit} ELSE try_cast({v} AS DOUBLE) END"


def _text(path: str) -> str:
    return f"json_extract_string(d, '$.{path}')"


def _duration(path: str) -> str:
    return _seconds(_text(path), f"json_type(d, '$.{path}')")


def _count(path: str) -> str:
    v = _text(path)
    return f"CASE WHEN json_type(d, '$.{path}') = 'VARCHAR' THEN try_cast(nullif(regexp_extract({v}, '[0-9]+'), '') AS BIGINT) ELSE trunc(try_cast({v} AS DOUBLE))::BIGINT END"


_A, _V, _N = 'Recording.Audio.', 'Recording.Visual', '"Sample Size".'
_FORMAT = f"lower(CASE json_type(d, '$.{_V}') WHEN 'VARCHAR' THEN {_text(_V)} ELSE {_text(_V + '.Format')} END)"
_SETTING = "lower(" + _text('"Emotional Annotation"."Experimental Setting"') + ")"
_DESCRIBED = f"lower({_text('Description')})"
_BINAURAL = f"CASE WHEN json_type(d, '$.{_A}Binaural.Duration') IN ('UBIGINT', 'BIGINT') AND {_text(_A + 'Binaural.Duration')} = '0' THEN {_duration(_A + 'Binaural.' + chr(34) + 'Duration(s)' + chr(34))} ELSE {_duration(_A + 'Binaural.Duration')} END"
CATALOGUE_SQL = f"""WITH c AS (SELECT 'set ' || p_partkey AS dataset_name, json_extract(value, '$."set ' || p_partkey || '"') AS d FROM (SELECT p_partkey, value FROM ({CATALOGUE.replace("AS value FROM part", "AS value, p_partkey FROM part")})))
SELECT dataset_name, {_text('Description')} AS description, {_count('Year')} AS year, {_text('Scenario')} AS scenario, CASE WHEN coalesce({_text('Link')}, 'no available link') = 'no available link' THEN '' ELSE {_text('Link')} END AS link,
CASE {_text('Access')} WHEN 'Partilally' THEN 'Partially' ELSE {_text('Access')} END AS access,
CASE WHEN {_DESCRIBED} LIKE '%cc by-nc-sa%' THEN 'CC-BY-NC-SA-4.0' WHEN {_DESCRIBED} LIKE '%cc by-nc%' THEN 'CC-BY-NC-4.0' WHEN {_DESCRIBED} LIKE '%cc by-sa%' THEN 'CC-BY-SA-4.0' WHEN {_DESCRIBED} LIKE '%cc by%' THEN 'CC-BY-4.0' ELSE 'Unknown' END AS licence_spdx,
coalesce(nullif({_count(_N + '"Audio Samples"')}, 0), {_count(_N + '"Audio Recording"')}) AS n_audio_samples, {_count(_N + 'Participants')} AS n_participants, {_count(_N + 'Assessments')} AS n_assessments, try_cast({_text(_N + '"Duration(mins)"')} AS DOUBLE) AS total_duration_min,
coalesce(json_exists(d, '$.{_A}Ambisonics'), false) AS audio_ambisonics_available, {_count(_A + 'Ambisonics."Bit Depth"')} AS audio_ambisonics_bit_depth, {_count(_A + 'Ambisonics."Sampling Rate"')} AS audio_ambisonics_sampling_rate_hz, {_count(_A + 'Ambisonics.Order')} AS audio_ambisonics_order, {_duration(_A + 'Ambisonics.Duration')} AS audio_ambisonics_clip_duration_s,
coalesce(json_exists(d, '$.{_A}Binaural'), false) AS audio_binaural_available, {_count(_A + 'Binaural."Bit Depth"')} AS audio_binaural_bit_depth, {_count(_A + 'Binaural."Sampling Rate"')} AS audio_binaural_sampling_rate_hz, {_BINAURAL} AS audio_binaural_clip_duration_s,
coalesce(json_exists(d, '$.{_A}Monaural'), false) AS audio_monaural_available, {_duration(_A + 'Monaural.Duration')} AS audio_monaural_clip_duration_s,
json_type(d, '$.{_V}') = 'VARCHAR' OR (json_type(d, '$.{_V}') = 'OBJECT' AND len(json_keys(d, '$.{_V}')) > 0) AS visual_available,
coalesce(CASE WHEN {_FORMAT} LIKE '%360%' THEN '360 Video' WHEN {_FORMAT} LIKE '%image%' THEN 'Images' WHEN {_FORMAT} LIKE '%video%' THEN 'Video' WHEN {_FORMAT} LIKE '%mixed%' THEN 'Mixed' END, '') AS visual_format,
coalesce(trim({_text(_V + '.Resolution')}), '') AS visual_resolution, {_count(_V + '."Frame Rate"')} AS visual_frame_rate_fps, {_duration(_V + '.Duration')} AS visual_clip_duration_s,
{_text('"Emotional Annotation"."Assessment Framework"')} AS annotation_framework,
CASE WHEN {_SETTING} LIKE '%site%' THEN 'On-site' WHEN {_SETTING} LIKE '%lab%' OR {_SETTING} LIKE '%vr%' THEN 'Lab-based' WHEN {_SETTING} = 'online' THEN 'Online' WHEN {_SETTING} LIKE '%mixed%' THEN 'Mixed' ELSE 'Other' END AS experimental_setting,
coalesce(json_type(d, '$."Acoustic Data"'), 'NULL') <> 'NULL' AS acoustic_data_available, {_text('"Acoustic Data"."Measuring Instrument"')} AS acoustic_measuring_instrument, coalesce(json_type(d, '$."Environmental Data"'), 'NULL') <> 'NULL' AS environmental_data_available FROM c"""


@query(CATALOGUE_SQL)
def b07_catalogue(spark, sf_dir):
    """JSON objects of datasets as 32 columns."""
    docs = spark.sql(CATALOGUE.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")))
    return catalogue.flattened(docs)


@query("SELECT framework, count(*) AS n FROM (SELECT p_brand AS framework FROM part) GROUP BY framework")
def b15_framework_counts(spark, sf_dir):
    """How many datasets name each framework, from the flattened catalogue."""
    rows = b07_catalogue(spark, sf_dir).filter("annotation_framework IS NOT NULL")
    return rows.groupBy(F.col("annotation_framework").alias("framework")).agg(F.count("*").alias("n"))
