"""Queries of record graphs, key filters and streams over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earshot.operators import keyfilters, lineage
from earshot.operators.tables import shared_folder
from earshot.plans.base import query
from earshot.sources.surveys import table
from earshot.streaming import repeats


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0 AND p_partkey IS NOT NULL)")
def j05_filtered_orphans(spark, sf_dir):
    """Line items whose part is none of a few: most are orphans, which a Bloom filter tells without a shuffle."""
    parents = table(spark, sf_dir, "part").filter("p_size % 10 = 0")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return keyfilters.filtered_orphans(rows, parents, "l_partkey", "p_partkey")


_DECLARED = """declared AS (SELECT id, type, count(*) AS n FROM (SELECT l_partkey::VARCHAR AS id, 'Part' AS type FROM lineitem UNION ALL SELECT l_suppkey::VARCHAR, 'Supplier' FROM lineitem) WHERE id IS NOT NULL GROUP BY id, type),
merged AS (SELECT id, count(*) AS n_types, sum(n)::BIGINT AS n, first(type ORDER BY n DESC, type) AS type FROM declared GROUP BY id)"""


def _declared(spark, sf_dir):
    return lineage.declared_nodes(table(spark, sf_dir, "lineitem"), [("Part", "l_partkey"), ("Supplier", "l_suppkey")])


@query(f"WITH {_DECLARED} SELECT id, type, n_types, n FROM merged")
def h06_merged_nodes(spark, sf_dir):
    """One node for each id, of the type that most rows give it."""
    return lineage.merged_nodes(_declared(spark, sf_dir))


@query(f"WITH {_DECLARED} SELECT id, d.type, d.type = m.type AS kept, d.n FROM declared d JOIN merged m USING (id) WHERE n_types > 1")
def h06_node_conflicts(spark, sf_dir):
    """Types of ids that are declared as parts and as suppliers."""
    return lineage.conflicts(_declared(spark, sf_dir))


_DERIVED = "SELECT event_id AS child, event_id // 7 AS parent FROM events WHERE event_id >= 7 UNION SELECT event_id, event_id // 11 FROM events WHERE event_id >= 11 AND event_id % 5 = 0"


@query(f"WITH RECURSIVE e AS ({_DERIVED}), c AS (SELECT child, parent AS ancestor, 1::BIGINT AS steps FROM e UNION SELECT c.child, e.parent, steps + 1 FROM c JOIN e ON c.ancestor = e.child) SELECT child, ancestor, min(steps) AS steps FROM c GROUP BY child, ancestor")
def h06_derived_from(spark, sf_dir):
    """All records that each record derives from, directly or by others, by the fewest steps."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("child"))
    by = lambda n: events.filter(F.col("child") >= n).withColumn("parent", F.floor(F.col("child") / n))
    return lineage.ancestors(by(7).unionByName(by(11).filter("child % 5 = 0")))


@query("SELECT event_id AS row_key, id FROM (SELECT event_id, id, min(event_id) OVER (PARTITION BY id) AS first FROM (SELECT event_id, user_id || '/' || event_type AS id FROM events)) WHERE id IS NOT NULL AND event_id > first")
def w04_stream_repeats(spark, sf_dir):
    """Later rows of a user and kind of event, found on a stream of the table's files (W04, F02 on streams)."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # the table may be a file or a folder
    rows = rows.select(F.col("event_id").cast("long").alias("row_key"), F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    repeats.repeats_stream(rows, f"{folder}/findings", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(repeats.FINDING).parquet(f"{folder}/findings").select("row_key", "id")
