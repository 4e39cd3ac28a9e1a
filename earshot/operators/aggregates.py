"""Clip-level aggregates of responses and of frame features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.scores import ITEMS, eventfulness, half_even, items, pleasantness

MICRO = 1_000_000


def with_coordinates(responses: DataFrame) -> DataFrame:
    """responses with pleasantness and eventfulness, rounded to 6; null where an item is."""
    return responses.withColumn("iso_pleasant", half_even(pleasantness(items()), 6)).withColumn("iso_eventful", half_even(eventfulness(items()), 6))


def clips_of_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Count, item means and the mean of response coordinates; sums are of whole millionths, so reruns agree."""
    exact = lambda c: F.sum(F.rint(F.col(c) * MICRO).cast("long")) / (F.count(c) * MICRO)
    means = [half_even(F.avg(i), 4).alias(f"mean_{i}") for i in ITEMS]
    return with_coordinates(responses).groupBy(*keys).agg(F.count("*").alias("n"), *means, half_even(exact("iso_pleasant"), 4).alias("iso_pleasant"), half_even(exact("iso_eventful"), 4).alias("iso_eventful"))


def clips_of_rounded_means(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Count, item means to 3 decimals and the coordinates of those; rows with a null key are left out."""
    out = responses.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"), *[half_even(F.avg(i), 3).alias(i) for i in ITEMS])
    return with_coordinates(out)


def frame_statistics(frames: DataFrame, scale: int) -> DataFrame:
    """Per clip and class, over the frames that have it: frames, mean, population deviation, least and most share.

    Shares are cents / scale; all sums are of integers.
    """
    c, n = F.col("cents"), F.col("n_frames")
    sums = frames.groupBy("clip", "class_name").agg(F.count("*").alias("n_frames"), F.sum("cents").alias("s"), F.sum(c * c).alias("ss"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    spread = F.sqrt((n * F.col("ss") - F.col("s") * F.col("s")).cast("double")) / (n * scale)
    return sums.select("clip", "class_name", "n_frames", half_even(F.col("s") / (n * scale), 6).alias("mean_ratio"), half_even(spread, 6).alias("std_ratio"), half_even(F.col("low") / scale, 6).alias("min_ratio"), half_even(F.col("high") / scale, 6).alias("max_ratio"))


def top_classes(totals: DataFrame, k: int = 4) -> DataFrame:
    """The k largest classes of each clip with their rank; of equal ones, that of the smallest `pos` (first seen) first."""
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cents")).alias("m"), "pos", "class_name"))), 1, k)  # classes per clip are few
    return totals.groupBy("clip").agg(ranked.alias("r")).select("clip", F.posexplode("r").alias("i", "e")).select("clip", (F.col("i") + 1).cast("long").alias("rank"), F.col("e.class_name").alias("class_name"), (-F.col("e.m")).alias("cents"))
