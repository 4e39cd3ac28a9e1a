"""Row rules on streams: rows that keep all constraints and findings of those that do not, in two tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.checks import Field, row_findings


def checked_stream(rows: DataFrame, key: str, fields: list[Field], good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes what is there now of a streaming table, then ends.

    Each batch's rows go to Parquet below `good`, its findings (row_key, field, rule) below `bad`, in a folder named
    by the batch, which is overwritten if the batch is run again after a failure: every row is written once.
    """
    broken = reduce(or_, [F.coalesce(b, F.lit(False)) for f in fields for _, b in f.broken()], F.lit(False))

    def write(batch: DataFrame, number: int) -> None:
        batch.filter(~broken).write.mode("overwrite").parquet(f"{good}/batch={number}")
        row_findings(batch, key, fields).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
