"""Bloom filters of keys as tables, and the anti join that one precedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.checks import orphans

#: Words of 64 bits in a row of a filter, bits that a key sets in its word, and bits planned for each key.
WORDS, PROBES, BITS_PER_KEY = 512, 4, 16
#: Bytes that a filter may have, as it is broadcast; keys of more rows are joined plainly.
MOST_BYTES = 64 << 20
#: Types whose equal values are equal bytes.
HASHED = ("tinyint", "smallint", "int", "bigint", "string", "date", "binary", "boolean")


def places(key: Column, rows: int) -> tuple[Column, Column, Column]:
    """The row of a filter that a key belongs to, its word there and the bits that it sets in it."""
    h, other = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(0)
    for i in range(1, PROBES):
        bits = bits.bitwiseOR(bit(i))
    return F.pmod(h, F.lit(rows)).cast("int"), F.shiftrightunsigned(other, 40).bitwiseAND(F.lit(WORDS - 1)).cast("int"), bits


def key_filter(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """_row and _words (array of WORDS longs): a filter of the keys, one row for each of 0 to rows - 1, even of no keys.

    Bits are joined before the shuffle, so that a key in many rows is no large group.
    """
    row, word, bits = places(F.col(key), rows)
    placed = keys.filter(F.col(key).isNotNull()).select(row.alias("_row"), word.alias("_word"), bits.alias("_bits"))
    blank = keys.sparkSession.range(rows * WORDS).select(F.floor(F.col("id") / WORDS).cast("int").alias("_row"), (F.col("id") % WORDS).cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = placed.unionByName(blank).groupBy("_row", "_word").agg(F.bit_or("_bits").alias("_bits"))
    listed = F.array_sort(F.collect_list(F.struct("_word", "_bits")))  # WORDS entries
    return words.groupBy("_row").agg(F.transform(listed, lambda w: w["_bits"]).alias("_words"))


def filtered_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of child whose key is not null and not in parent, as checks.orphans() gives them.

    A Bloom filter of the parent's keys, of BITS_PER_KEY bits for each of its rows, is broadcast. Children that it does not
    know are orphans for sure; only the others, orphans by about one in a hundred, are shuffled to the parent's keys. That pays
    where many children are orphans, as child is read for both. Where the filter would have more than most_bytes, the two
    keys have different types, or a type whose equal values may differ in bytes, this is the plain join. An empty parent
    leaves all children with a key, an empty child none.
    """
    kinds = {dict(df.dtypes)[key] for df, key in ((child, child_key), (parent, parent_key))}
    n = parent.count()
    rows = -(-max(n, 1) * BITS_PER_KEY // (WORDS * 64))
    if len(kinds) > 1 or kinds.pop() not in HASHED or rows * WORDS * 8 > most_bytes:
        return orphans(child, parent, child_key, parent_key).select(*child.columns)
    row, word, bits = places(F.col(child_key), rows)
    probed = child.filter(F.col(child_key).isNotNull()).withColumns({"_row": row, "_word": word, "_bits": bits})
    probed = probed.join(F.broadcast(key_filter(parent, parent_key, rows)), "_row")
    maybe = F.get("_words", F.col("_word")).bitwiseAND(F.col("_bits")) == F.col("_bits")
    # an outer join, as the optimizer moves an anti join below the filter, where it shuffles all children
    known = parent.select(F.col(parent_key).alias(child_key)).distinct().withColumn("_known", F.lit(True))
    lost = probed.filter(maybe).select(*child.columns).join(known, child_key, "left").filter("_known IS NULL")
    return probed.filter(~maybe).select(*child.columns).unionByName(lost.select(*child.columns))
