"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints within two bits agree in at least six of their eight positional bytes. The index has a posting list for
the bytes at four positions (any two of the four position couples 01, 23, 45, 67): two differing bytes leave at least
two couples whole, so that every pair to be found shares a list. In a list the shared positional bytes of a pair are
tallied, pairs with the guaranteed six are kept, and their bits compared. Longer lists are inverted again by two more
bytes, which gives all pairs that reach six; where those lists are long still, their fingerprints differ in two bytes
alone, and each looks up the few that two bits away could be. Lists of more than LIST_ROWS fingerprints are dealt
again by two more whole bytes before that, after which no list can hold more than 2**16.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, partitions_for, saved, small_batches
from earshot.llm.components import components, local_roots

WORDS, SEED, BITS, MAX_BITS = 3, 42, 64, 2
#: Positional bytes that two fingerprints within MAX_BITS share at least.
MIN_SHARED = 8 - MAX_BITS
LIST_ROWS = 20_000
#: Lists up to this size are tallied pair by pair, longer ones by a further index.
PAIRWISE = 64
COUPLES = [0xFFFF << (16 * i) for i in range(4)]
BYTES = [0xFF << (8 * i) for i in range(8)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 where there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(whole, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - WORDS + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (long, the fingerprint's bits) of each row of docs(doc_id, text); a null text
    counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


Pairs = tuple[np.ndarray, np.ndarray]


def tallied(fps: np.ndarray, lists: np.ndarray) -> tuple[Pairs, list[np.ndarray]]:
    """Indices of pairs within MAX_BITS in the same list, of lists up to PAIRWISE; and the indices of each longer list.
    Rows come list by list."""
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(lists)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat(sizes <= PAIRWISE, sizes)
    reach = np.repeat(starts + sizes, sizes)  # end of the row's list
    for d in range(1, min(PAIRWISE, int(sizes.max(initial=1)))):
        i = np.flatnonzero(short[: len(fps) - d] & (np.arange(len(fps) - d) + d < reach[: len(fps) - d]))
        if not len(i):
            break
        differ = fps[i] ^ fps[i + d]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        i, differ = i[shared >= MIN_SHARED], differ[shared >= MIN_SHARED]
        near = i[np.bitwise_count(differ) <= MAX_BITS]
        left.append(near)
        right.append(near + d)
    long = [np.arange(a, a + n) for a, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist())]
    return (np.concatenate(left), np.concatenate(right)), long


def looked_up(fps: np.ndarray, varying: int) -> Pairs:
    """Pairs within MAX_BITS among distinct fingerprints that differ in the bits of `varying` alone."""
    order = np.argsort(fps)
    own, left, right = fps[order], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits = [np.uint64(1 << i) for i in range(BITS) if varying >> i & 1]
    for flip in [*bits, *(a | b for a, b in combinations(bits, 2))]:
        other = own ^ flip
        place = np.minimum(np.searchsorted(own, other), len(own) - 1)
        hit = np.flatnonzero((own[place] == other) & (own < other))
        left.append(order[hit])
        right.append(order[place[hit]])
    return np.concatenate(left), np.concatenate(right)


def linked(fps: np.ndarray, lists: np.ndarray) -> Pairs:
    """Indices of pairs of distinct fingerprints within MAX_BITS in the same list; rows come list by list."""
    pairs, long = tallied(fps, lists)
    found = [pairs]
    for rows in long:
        varies = int(np.bitwise_or.reduce(fps[rows] ^ fps[rows[0]]))
        places = [b for b in BYTES if varies & b]
        for couple in combinations(places, 2) if len(places) > 1 else [places]:
            mask = sum(couple)
            key = fps[rows] & np.uint64(~mask & (1 << BITS) - 1)
            order = np.argsort(key, kind="stable")
            mine, listed = rows[order], key[order]
            pairs, still = tallied(fps[mine], listed)
            found.append((mine[pairs[0]], mine[pairs[1]]))
            for part in still:
                pairs = looked_up(fps[mine[part]], varies & mask)
                found.append((mine[part[pairs[0]]], mine[part[pairs[1]]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def link_lists(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) between fingerprints of the same list that keep all that its links connect: at most one per row."""

    def work(lists: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = local_roots(len(fps), *linked(fps, lists)) if len(fps) else np.zeros(0, np.int64)
        i = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[root[i]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, len(keys)), np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            new = [np.stack([batch.column(k).to_numpy() for k in keys], axis=1), batch.column("fp").to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            changes = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))
            if len(changes) and len(held[1]) >= 20_000:  # all lists but the last are complete
                n = changes[-1] + 1
                yield work(_numbered(held[0][:n]), held[1][:n])
                held = [x[n:] for x in held]
        yield work(_numbered(held[0]), held[1])

    dealt = postings.repartition(partitions_for(postings.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "fp").mapInArrow(run, "a long, b long")


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)


def masked(options: list[int]) -> Column:
    """array<struct<n, key>> of the fingerprint under each of some masks."""
    return F.array(*[F.struct(F.lit(i).cast("long").alias("n"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(options)])


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, group and component_id of each row of docs(doc_id, text).

    Fingerprints of at most two differing bits link; `group` is the smallest fingerprint, component_id the smallest
    doc_id that links reach. Texts of no word have fingerprint zero and link like any other; repeated rows are of one
    group; rows of one doc_id with other texts are of their own texts' groups; rows with a null doc_id are of their
    fingerprint's group and never name one; an empty table gives an empty table.
    """
    fps = saved(fingerprints(docs))
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    masks = [a | b for a, b in combinations(COUPLES, 2)]
    postings = classes.withColumn("list", F.explode(masked(masks))).select("fp", "list.n", "list.key")
    hot = saved(postings.groupBy("n", "key").count().filter(F.col("count") > LIST_ROWS).select("n", "key"))
    edges = link_lists(postings.join(hot, ["n", "key"], "left_anti"), ["n", "key"])
    if not hot.isEmpty():
        # the four bytes that a hot list leaves open: two of them are whole
        splits = []
        for i, m in enumerate(masks):
            for j, pair in enumerate(combinations([b for b in BYTES if not b & m], 2)):
                splits.append(F.struct(F.lit(j).cast("long").alias("n2"), F.col("fp").bitwiseAND(F.lit(signed(m | pair[0] | pair[1]))).alias("key2"), F.lit(i).cast("long").alias("of")))
        again = postings.join(hot, ["n", "key"], "left_semi").withColumn("s", F.explode(F.filter(F.array(*splits), lambda x: x["of"] == F.col("n"))))
        edges = edges.unionByName(link_lists(again.select("fp", "n", F.col("s.n2").alias("n2"), F.col("s.key2").alias("key2")), ["n", "n2", "key2"]))
    comps = components(edges)
    rooted = saved(classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    # a group of one fingerprint has that one's smallest doc_id; only the others meet again
    several = rooted.filter("group <> fp").select("group").distinct()
    least = rooted.join(several, "group").groupBy("group").agg(F.min("rep").alias("least"))
    named = rooted.join(least, "group", "left").select("fp", "group", F.coalesce("least", "rep").alias("component_id"))
    discard(hot)
    discard(classes)
    return fps.join(named, "fp").select("doc_id", "h", "fp", "group", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of grouped(), in the columns of docs: that of its smallest doc_id, of several texts
    of this id that of the smallest hash, of several rows alike in both any one.

    Rows with a null doc_id, which nothing can name, all stay. Columns may have any names.
    """
    found = grouped(docs).filter("doc_id IS NOT NULL")
    kept = saved(found.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("_k0"), F.col("k.h").alias("_k1")))
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(whole.alias("row"), docs["doc_id"].cast("long").alias("_d"), F.xxhash64(docs["text"]).alias("_h"))
    named = rows.join(kept, (F.col("_d") == F.col("_k0")) & (F.col("_h") == F.col("_k1"))).dropDuplicates(["_k0", "_k1"]).select("row.*")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from grouped()."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
