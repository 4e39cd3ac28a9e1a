"""Survey-shaped tables derived from the given ones by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.scores import ITEMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stimulus_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to masked stimuli, one per line item; some items missing."""
    rated = [f"CASE WHEN (l_orderkey + {i}) % 37 = 0 THEN NULL ELSE cast(1 + (l_orderkey * {i} + l_partkey + l_linenumber) % 5 AS double) END AS {item}" for i, item in enumerate(ITEMS, 1)]
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS response_key", "l_linenumber AS line", "l_partkey AS part_key", "l_orderkey % 500 AS participant", "l_suppkey % 10 - 1 AS fold",
        "concat('R', lpad(cast(l_partkey % 40 AS string), 4, '0'))  AS soundscape", "concat(l_returnflag, l_linestatus) AS masker", "cast((l_linenumber % 5 - 2) * 3 AS bigint) AS smr", *rated)


STIMULUS_SQL = "stimulus AS (SELECT l_orderkey AS response_key, l_linenumber AS line, l_partkey AS part_key, l_orderkey % 500 AS participant, l_suppkey % 10 - 1 AS fold, 'R' || lpad((l_partkey % 40)::VARCHAR, 4, '0') AS soundscape, l_returnflag || l_linestatus AS masker, ((l_linenumber % 5 - 2) * 3)::BIGINT AS smr, " + ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % 37 = 0 THEN NULL ELSE (1 + (l_orderkey * {i} + l_partkey + l_linenumber) % 5)::DOUBLE END AS {item}" for i, item in enumerate(ITEMS, 1)) + " FROM lineitem)"


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per participant: the customer of the smallest key."""
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 500).alias("participant"))
    return c.agg(F.min_by("c_mktsegment", "c_custkey").alias("language"), (F.min("c_custkey") % 60 + 18).alias("age"))


PARTICIPANTS_SQL = "participants AS (SELECT c_custkey % 500 AS participant, arg_min(c_mktsegment, c_custkey) AS language, min(c_custkey) % 60 + 18 AS age FROM customer GROUP BY 1)"


def place_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses on site: location (missing for some), session and group."""
    rated = [f"cast(1 + (o_orderkey * {i} + o_custkey) % 5 AS double) AS {item}" for i, item in enumerate(ITEMS, 1)]
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS response_key", "CASE WHEN o_custkey % 25 = 7 THEN NULL ELSE concat('L', o_custkey % 25) END AS location", "cast(year(o_orderdate) AS bigint) AS session", "o_custkey % 20 AS grp", *rated)


PLACES_SQL = "places AS (SELECT o_orderkey AS response_key, CASE WHEN o_custkey % 25 = 7 THEN NULL ELSE 'L' || (o_custkey % 25) END AS location, year(o_orderdate)::BIGINT AS session, o_custkey % 20 AS grp, " + ", ".join(
    f"(1 + (o_orderkey * {i} + o_custkey) % 5)::DOUBLE AS {item}" for i, item in enumerate(ITEMS, 1)) + " FROM orders)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares of video frames in whole cents: clip, frame (a day), class_name, cents."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS clip", "cast(ts AS date) AS frame", "event_type AS class_name", "cast(rint(value * 100) AS bigint) AS cents").groupBy("clip", "frame", "class_name").agg(F.sum("cents").alias("cents"))


FRAMES_SQL = "frames AS (SELECT user_id AS clip, ts::DATE AS frame, event_type AS class_name, sum(round_even(value * 100, 0)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2, 3)"
