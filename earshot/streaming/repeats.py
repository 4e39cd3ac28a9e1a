"""Later repeats of ids on streams: state in tables, findings equal to those of a batch at any order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A batch with a number divisible by this writes the whole state, others what they change.
WHOLE_EVERY = 10
FINDING = "row_key long, id string"


def folders(number: int) -> range:
    """The numbers of the batches whose folders hold the state before a batch: from the last whole one on."""
    return range(max(number - 1, 0) // WHOLE_EVERY * WHOLE_EVERY, number)


def repeats_of(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(findings(row_key, id), changed(id, first, seen)) of a batch(row_key, id, at), by what the state holds of its ids.

    A finding is every row but the one of the smallest row_key of its id. Where a batch has a smaller one than all before,
    the one that was first until then is a finding. Minima precede the shuffle, so that a hot id is no large group; the
    join with the rows may split one.
    """
    rows = batch.filter("id <> ''").select("row_key", "id", "at")
    mine = rows.groupBy("id").agg(F.min("row_key").alias("first"), F.max("at").alias("seen"), F.count("*").alias("n"))
    if state is None:
        before = mine.select("id", F.lit(None).cast("long").alias("old"), F.lit(None).cast("timestamp").alias("old_seen")).limit(0)
    else:
        before = state.groupBy("id").agg(F.min("first").alias("old"), F.max("seen").alias("old_seen"))
    known = mine.join(before, "id", "left").select("id", F.least("first", "old").alias("first"), F.greatest("seen", "old_seen").alias("seen"), "n", "old")
    later = rows.join(known.filter("n > 1 OR old IS NOT NULL").select("id", "first"), "id").filter("row_key > first").select("row_key", "id")
    replaced = known.filter("old > first").select(F.col("old").alias("row_key"), "id")
    return later.unionByName(replaced), known.select("id", "first", "seen")


def repeats_stream(rows: DataFrame, findings: str, state: str, checkpoint: str, forget: str | None = None) -> StreamingQuery:
    """Start a query that writes the later repeats of what is there now of a streaming table(row_key long, id string, at
    timestamp), then ends; another start with the same folders goes on.

    Findings go to a folder of `findings` for each batch, the smallest row_key and the latest time of the ids that it
    touches to one of `state`; both are overwritten if the batch is run again after a failure, and a batch reads only folders
    of earlier ones: rows count once. Every WHOLE_EVERY batches the state is written whole; then ids last seen longer than
    `forget` (an interval such as "30 days") before the latest time of all are left out, and start afresh if they come again.
    Without it, all batches together give the findings of one batch over all rows. Empty and null ids repeat nothing; row
    keys are unique.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(*[f"{state}/batch={k}" for k in folders(number)]) if number else None
        found, changed = repeats_of(batch, held)
        if number and number % WHOLE_EVERY == 0:
            changed = held.unionByName(changed).groupBy("id").agg(F.min("first").alias("first"), F.max("seen").alias("seen"))
            if forget:
                latest = changed.agg(F.max("seen").alias("_latest"))  # one row
                old = F.expr(f"seen < _latest - INTERVAL {forget}")
                changed = changed.join(F.broadcast(latest)).filter(F.coalesce(~old, F.lit(True))).drop("_latest")
        found.write.mode("overwrite").parquet(f"{findings}/batch={number}")
        changed.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
