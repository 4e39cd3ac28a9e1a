"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every source is a queue of its documents in hash-shuffled order, repeated up to MAX_EPOCHS times. A document
gets a virtual finish time: the tokens of its queue up to and with it, divided by the queue's target. All
documents of all queues, sorted by finish time, are taken until the total budget is reached.

Running sums never put a source, an id or a text into one task: rows are range-partitioned by a sort key that no two
share, sums of ranges are accumulated over the small table of ranges, and each range adds its own running sum to its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import WORD, discard, partitions_for, saved

MAX_EPOCHS = 3
#: Rows of a stretch of the finish order, and of a range of the queues where there are more than Spark's partitions hold.
BUCKET_ROWS, RANGE_ROWS = 20_000, 1_000_000
WEIGHTS = (5, 2, 1)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A weight for each row of sizes(source, source_size): sources by code point, null last, take weights in turn."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))


def water_filled(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets that share the sum of all sizes by weight, none above max_epochs times its source's size.

    Sources whose limit is small for their weight are full; with the sources in the order of limit/weight, the
    first whose limit is above the level reached without it sets the level of all after it.
    """
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = (F.col("source_size") * max_epochs).cast("long")
    ranked = (
        sizes.withColumn("ratio", limit.cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0))).cast("double") / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("settled", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("settled").isNull() | (F.col("ratio") <= F.col("settled")), limit.cast("double")).otherwise(F.col("settled") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


#: The order of a queue: by u, and among rows of one id by size, text and place in the table.
ORDER = ["u", "doc_id", "size", "h", "row"]


def sized_rows(rows: DataFrame, seed: int) -> DataFrame:
    """rows(row, doc_id, text, source) with size, u and h instead of the text, in a table."""
    return saved(rows.select("row", "doc_id", "source", words_of(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("u"), F.xxhash64("text").alias("h")))


def queued(sized: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Each row of sized with its source's size and target, and cum: the tokens of its queue up to and with it.

    Rows are range-partitioned in the order of the queues, which ends in a number that no other row has: however many rows
    share a source, an id or a text, they are spread, and sums of partitions say where each begins.
    """
    targets = water_filled(cyclic_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), max_epochs)
    ranges = max(partitions_for(sized.sparkSession), sized.count() // RANGE_ROWS + 1)
    dealt = sized.repartitionByRange(ranges, "source", *ORDER).withColumn("b", F.spark_partition_id())
    own = Window.partitionBy("source", "b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    dealt = saved(dealt.withColumn("upto", F.sum("size").over(own)))
    sums = dealt.groupBy("source", "b").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("source", "b", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("start"))
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "s.b", "s.start", "t.source_size", "t.target")
    placed = dealt.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source AND d.b = s.b"))
    line = saved(placed.select("d.row", "d.doc_id", "d.source", "d.u", "d.size", "d.h", "s.source_size", "s.target", (F.col("d.upto") + F.col("s.start")).alias("cum")))
    discard(dealt)
    return line


def finish_time(epoch: Column) -> Column:
    return F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")).otherwise(F.lit(0.0))


def line_key(finish: Column) -> Column:
    """The place in the line of all documents of all epochs; comparable as a struct."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return F.struct(finish.alias("finish"), F.col("source").isNull().alias("nameless"), source.alias("source"), *ORDER)


def first_left(line: DataFrame, max_epochs: int):
    """The key of the first document that the budget does not hold, as a Row; None where it holds all.

    Documents without tokens, which may share one finish time, are never it; all others of a queue have times of their own.
    """
    full = line.filter("size > 0")
    rows = full.count()
    # All queues advance evenly in virtual time, so equal stretches of it hold about equal numbers of tokens; the
    # budget ends soon after time 1, and what is far beyond is one stretch.
    stretches = max(1, rows // BUCKET_ROWS)
    epochs = full.withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs))))).withColumn("finish", finish_time(F.col("epoch")))
    epochs = epochs.withColumn("stretch", F.least(F.floor(F.col("finish") * stretches), F.lit(2 * stretches + 64)).cast("long"))
    per = epochs.groupBy("stretch").agg(F.sum("size").alias("tokens"))
    upto = per.withColumn("end", F.sum("tokens").over(Window.orderBy("stretch")))
    budget = full.agg(F.sum("size")).first()[0] or 0
    over = upto.filter(F.col("end") > budget).orderBy("stretch").first()
    if over is None:
        return None
    room = budget - (over["end"] - over["tokens"])
    inside = epochs.filter(F.col("stretch") == over["stretch"]).withColumn("key", line_key(F.col("finish")))
    # a stretch holds a bounded share of all tokens: it is one sort
    upto = inside.withColumn("sum", F.sum("size").over(Window.partitionBy("stretch").orderBy("key")))
    return upto.filter(F.col("sum") > room).agg(F.min("key").alias("key")).first()["key"]


def as_literal(key, types) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, types.fields)])


def times_taken(sized: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """sized with source_size, target and times, in a table."""
    line = queued(sized, max_epochs, weights)
    end = first_left(line, max_epochs)
    if end is None:
        times = F.lit(max_epochs)
    else:
        end = as_literal(end, line.select(line_key(F.lit(0.0)).alias("key")).schema["key"].dataType)
        times = sum((F.when(line_key(finish_time(F.lit(e))) < end, 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    return line.select("row", "doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"))


def mix_counts(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """How often each row of docs(doc_id, text, source) is taken.

    Returns doc_id, source, size, source_size, target and times (0 to max_epochs), one row for each input row. A null text
    has size 0; a null source is a source; a null doc_id is shuffled like the empty string; rows of one doc_id follow one
    another by size and text; an empty table gives an empty table; other columns are ignored. A document is taken whole or
    not at all in each epoch, so that a source ends within about one document of its target.
    """
    sized = sized_rows(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"), seed)
    out = times_taken(sized, max_epochs, weights).drop("row")
    discard(sized)
    return out


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """docs with each row as often as mix_counts takes it, in the columns of docs, whatever their names.

    Rows get numbers in a table, by which times come back to them: no two rows share one. Of rows alike in doc_id, source,
    size and text, which are taken more often is open; reruns agree in all else.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_row"), whole.alias("_doc")))
    sized = sized_rows(rows.select(F.col("_row").alias("row"), "_doc.doc_id", "_doc.text", "_doc.source"), seed)
    taken = times_taken(sized, max_epochs, weights).filter("times > 0").select(F.col("row").alias("_row"), F.col("times").alias("_times"))
    discard(sized)
    return rows.join(taken, "_row").withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_doc.*")
