"""Dense numbers, repeated keys and last-wins rows at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.tables import free, saved


def dense_numbers(df: DataFrame, keys: list[str], name: str = "number", once: bool = True) -> DataFrame:
    """df with the place of each row (from 1) in the order of keys, nulls last; rows of equal keys in any order, the same
    in each run over the result.

    df is computed once, into a table from which rows are range-sorted into another, which stays until the application
    ends. With once=False it is read twice, for the ranges and for the rows: cheaper where df only reads a stored table.
    Counts per range give each its first number, so no task sees all rows; rows of equal keys are parted too, by their
    place in df. An empty table gives an empty table.
    """
    order = [*[F.col(k).asc_nulls_last() for k in keys], F.col("_row").asc()]
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    placed = saved(placed) if once else placed
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    table = saved(dealt.withColumns({"_at": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    free(placed)
    sizes = table.groupBy("_at").agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("_at", F.coalesce(F.sum("n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(F.broadcast(before), "_at", "left").withColumn(name, F.col("_before") + within + 1).select(*df.columns, name)


def suffix_repeats(df: DataFrame, key: str, order: list[str], name: str, once: bool = True) -> DataFrame:
    """df with name: the key, followed by _R00, _R01, ... (wider from 100 on) on every row of a key that occurs more than
    once, in order; rows of a null key get null.

    A row's place is its number in the order of all rows less the first of its key, so that no task holds all rows of
    a key; firsts are pre-aggregated, and their join may split a hot key. once is as in dense_numbers().
    """
    numbered = dense_numbers(df, [key, *order], "_number", once)
    firsts = numbered.groupBy(key).agg(F.min("_number").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1")
    suffix = F.when(F.col("_first").isNotNull(), F.format_string("_R%02d", F.col("_number") - F.col("_first"))).otherwise("")
    return numbered.join(firsts, key, "left").withColumn(name, F.concat(key, suffix)).select(*df.columns, name)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in order; partial maxima precede the shuffle, so hot keys are safe."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and all of new, in old's columns."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
