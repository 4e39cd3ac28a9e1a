"""A catalogue of datasets as JSON objects by name, flattened to one row for each dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.catalogue import access, at, count_of, duration_of, first_given, has_key, licence, link, number_of, setting, visual_format, visual_object
from earshot.operators.samples import is_object, kind_is, members, plain


def datasets_of(docs: DataFrame) -> DataFrame:
    """dataset_name and _d (variant) of every entry of JSON objects docs(value); texts that are no object have none."""
    return docs.select(F.explode(members(F.try_parse_json("value"))).alias("dataset_name", "_d"))


def flattened(docs: DataFrame) -> DataFrame:
    """The catalogue's 32 columns for every entry of docs(value)."""
    d, visual = F.col("_d"), F.col("_visual")
    audio = at(d, "Recording", "Audio")
    size = lambda k: at(d, "Sample Size", k)
    see = lambda k: F.try_element_at(visual, F.lit(k))
    text = lambda v: F.when(~kind_is(v, "VOID"), plain(v))
    rows = datasets_of(docs).withColumn("_visual", visual_object(F.try_variant_get("_d", '$["Recording"]["Visual"]', "variant")))
    known = lambda kind: F.when(is_object(audio), has_key(audio, kind)).otherwise(F.lit(False))
    columns = {
        "description": text(at(d, "Description")), "year": count_of(at(d, "Year")), "scenario": text(at(d, "Scenario")), "link": link(text(at(d, "Link"))),
        "access": access(text(at(d, "Access"))), "licence_spdx": licence(text(at(d, "Description"))),
        "n_audio_samples": count_of(first_given(size("Audio Samples"), size("Audio Recording"))), "n_participants": count_of(size("Participants")),
        "n_assessments": count_of(size("Assessments")), "total_duration_min": number_of(size("Duration(mins)")),
        "audio_ambisonics_available": known("Ambisonics"), "audio_ambisonics_bit_depth": count_of(at(audio, "Ambisonics", "Bit Depth")),
        "audio_ambisonics_sampling_rate_hz": count_of(at(audio, "Ambisonics", "Sampling Rate")), "audio_ambisonics_order": count_of(at(audio, "Ambisonics", "Order")),
        "audio_ambisonics_clip_duration_s": duration_of(at(audio, "Ambisonics", "Duration")),
        "audio_binaural_available": known("Binaural"), "audio_binaural_bit_depth": count_of(at(audio, "Binaural", "Bit Depth")),
        "audio_binaural_sampling_rate_hz": count_of(at(audio, "Binaural", "Sampling Rate")),
        "audio_binaural_clip_duration_s": duration_of(first_given(at(audio, "Binaural", "Duration"), at(audio, "Binaural", "Duration(s)"))),
        "audio_monaural_available": known("Monaural"), "audio_monaural_clip_duration_s": duration_of(at(audio, "Monaural", "Duration")),
        "visual_available": F.size(visual) > 0, "visual_format": visual_format(text(see("Format"))), "visual_resolution": F.coalesce(F.trim(text(see("Resolution"))), F.lit("")),
        "visual_frame_rate_fps": count_of(see("Frame Rate")), "visual_clip_duration_s": duration_of(see("Duration")),
        "annotation_framework": text(at(d, "Emotional Annotation", "Assessment Framework")), "experimental_setting": setting(text(at(d, "Emotional Annotation", "Experimental Setting"))),
        "acoustic_data_available": at(d, "Acoustic Data").isNotNull(), "acoustic_measuring_instrument": text(at(d, "Acoustic Data", "Measuring Instrument")),
        "environmental_data_available": at(d, "Environmental Data").isNotNull(),
    }
    return rows.select("dataset_name", *[c.alias(name) for name, c in columns.items()])
