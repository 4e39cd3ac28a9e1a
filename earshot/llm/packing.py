"""Best-fit packing of tokenised documents with certified bin counts.

Pieces (documents, or parts of those longer than a sequence) are dealt into partitions of bounded size. Each packs
its own by best-fit decreasing and bounds its bin count from below by dual-feasible functions. While the sum of the
bin counts is above the bound of the whole, partitions exchange pieces: those whose count is above their bound, or
that have a bin's worth of room left, give those of their emptiest bins, certified others only those of the emptiest
one. Groups of partitions pack these again, then groups of groups, up to one. If the bound of the whole is not met by then,
a second turn follows in which all partitions give like those that are not certified, as bounds of many partitions are
each rounded up. After it, a third could only pack the last group again. A new packing replaces the old one where it has
fewer bins, or bins that leave more of their room in one place.

A bin is known by its partition and its number there. Every packing is written once, with what each turn opens; only pieces
of open bins are packed and written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, saved, small_batches

SEQUENCE = 2048
END_ID = 0
#: Pieces of a partition, partitions that exchange pieces in a group, and partitions' worth of pieces that each may give.
PART_PIECES = 20_000
FAN_IN, GIVE = 8, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
PACKED = PIECES + ", uid long, part long, bin long, offset long, open boolean, spare boolean, part_bins long, part_bound long"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
#: Partition numbers of one level of exchange, and bin numbers of a partition: more than the pieces of a group.
LEVEL, BINS = 1 << 30, 1 << 24
#: Rounding functions u^(1), u^(2), ... that bounds try.
ROUNDINGS = 12


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None):
    """The byte-level vocabulary of byte_bpe_50k.json, by its ranks file: equal ids, several times as fast, once texts
    are split at the JSON's added tokens, which the ranks file leaves out."""
    import base64
    import json

    import public_tokenizers as P
    import tiktoken

    with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as whole:
        added = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut_points(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of limit but the first, which takes the remainder."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)]


def tokenized(docs: DataFrame, limit: int = SEQUENCE, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32.

    A null text counts as empty: one piece of the end id alone. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(ranks_path).encode, allowed_special="all")
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array(encode(text or "") + [END_ID], dtype="<u4")
                rows += [(i, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut_points(len(ids), limit))]
            doc, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            ids = batch.column("doc_id").take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, limit: int) -> int:
    """Bins that any packing of counts[length] pieces of each length needs, by dual-feasible functions.

    The threshold functions (long pieces count whole, short ones nothing; the first leaves all as they are), each by
    itself and followed by the rounding functions of Fekete and Schepers, as integer sums.
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    have = np.flatnonzero(counts)
    if not len(have):
        return 0
    n, x = counts[have].astype(np.int64), lengths[have]
    thresholds, best = np.r_[0, x[x <= limit // 2]], 0
    for at in range(0, len(thresholds), 256):
        eps = thresholds[at : at + 256, None]
        size = np.where(x > limit - eps, limit, np.where(x < eps, 0, x))  # a row for each threshold
        best = max(best, -(-int((size @ n).max()) // limit))
        for k in range(1, ROUNDINGS + 1):  # u^(k): x (k+1) / limit rounded down to 1/k, exact multiples left as they are
            scaled = size * (k + 1)
            num = np.where(scaled % limit == 0, size * k, (scaled // limit) * limit)  # of k * limit
            best = max(best, -(-int((num @ n).max()) // (k * limit)))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each piece, lengths in decreasing order, and the fill of each bin."""
    room: list[list[int]] = [[] for _ in range(limit + 1)]  # open bins by the room they have
    mask, fill = 0, []  # bit r: some bin has room r
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(fill), limit
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def emptiest(bins: np.ndarray, fill: np.ndarray, limit: int, give: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, whether it lies in the emptiest bin, if that is not full, and in the emptiest ones of up to `give`
    pieces together."""
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < limit]
    first, many = np.zeros(len(fill), bool), np.zeros(len(fill), bool)
    first[order[:1]] = True
    many[order[np.bincount(bins, minlength=len(fill))[order].cumsum() <= give]] = True
    return first[bins], (first | many)[bins]


@dataclass(frozen=True)
class Exchange:
    """The size of a bin and the most pieces that a partition gives."""

    limit: int
    give: int


def with_places(rows: pa.Table, part: int, bins: np.ndarray, offsets: np.ndarray, how: Exchange) -> pa.Table:
    """rows in the bins of a partition, with what is open, their number and its bound."""
    limit = how.limit
    lengths = rows.column("length").to_numpy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    if len(fill) > BINS or len(fill) and fill.max() > limit:
        raise ValueError(f"partition {part}: {len(fill)} bins, the fullest of {fill.max()}")
    bound = lower_bound(np.bincount(lengths, minlength=limit + 1), limit)
    same = lambda x: np.full(len(rows), x, np.int64)
    certified = len(fill) <= bound and len(fill) * limit - fill.sum() < limit
    first, many = emptiest(bins, fill, limit, how.give)
    columns = [*(rows.column(c) for c in (*NAMES, "uid")), *map(pa.array, (same(part), bins, offsets, first if certified else many, many, same(len(fill)), same(bound)))]
    return pa.table(columns, names=PACKED_NAMES)


def pack_group(rows: pa.Table, part: int, how: Exchange) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("uid", "ascending")])
    bins, offsets, _ = best_fit_decreasing(rows.column("length").to_numpy(), how.limit)
    return with_places(rows, part, bins, offsets, how)


def numbered_bins(rows: pa.Table) -> np.ndarray:
    """The bins of rows of several partitions, from 0."""
    parts = np.unique(rows.column("part").to_numpy(), return_inverse=True)[1].ravel()
    bins = np.unique(rows.column("bin").to_numpy(), return_inverse=True)[1].ravel()
    return np.unique(parts * (bins.max(initial=0) + 1) + bins, return_inverse=True)[1].ravel()


def repack_group(rows: pa.Table, part: int, how: Exchange) -> pa.Table:
    """The open pieces of several partitions packed anew, or left as they were if that is no better."""
    new = pack_group(rows, part, how)
    bins = numbered_bins(rows)
    old_fill = np.bincount(bins, weights=rows.column("length").to_numpy())
    new_fill = np.bincount(new.column("bin").to_numpy(), weights=new.column("length").to_numpy())
    if (len(new_fill), -(new_fill**2).sum()) < (len(old_fill), -(old_fill**2).sum()):
        return new
    return with_places(rows, part, bins, rows.column("offset").to_numpy(), how)


def by_part(rows: DataFrame, column: str, work, how: Exchange) -> DataFrame:
    return rows.groupBy(column).applyInArrow(lambda key, group: work(group, key[0].as_py(), how), PACKED)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def pack(pieces: DataFrame, limit: int = SEQUENCE, part_pieces: int = PART_PIECES) -> DataFrame:
    """PIECES with sequence_id (any distinct numbers) and offset, gapless from 0 in each sequence.

    An empty table gives an empty table; pieces of equal length are taken by doc_id and piece; repeated rows are
    pieces of their own, and dealt out like any others. Lengths must be 1 to limit. `certified`: the partition that packed
    the sequence met its own bound; `bins_above_bound`: sequences of the whole beyond its bound, 0 where the bound
    certifies them.
    """
    if FAN_IN * GIVE * part_pieces >= BINS:
        raise ValueError(f"a group of partitions of {part_pieces} pieces may need more than {BINS} bins")
    spark = pieces.sparkSession
    pieces = saved(pieces.select(NAMES).withColumn("uid", F.monotonically_increasing_id()))
    counts = np.zeros(limit + 1, np.int64)  # of each length
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    need, parts = lower_bound(counts, limit), max(1, -(-int(counts.sum()) // part_pieces))
    how = Exchange(limit, part_pieces * GIVE)
    tasks = max(spark.sparkContext.defaultParallelism, parts // 8)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    packed = saved(by_part(keyed.repartition(tasks, "part"), "part", pack_group, how))
    discard(pieces)
    bins_of = lambda df: df.select("part", "bin").distinct().count()
    have, level, settled = bins_of(packed), 0, [packed]
    for turn in ("open", "spare"):  # the column that says what a turn opens
        if parts == 1 or have <= need:
            break
        loose, settled, groups = union(settled).filter(turn), [df.filter(f"NOT {turn}") for df in settled], parts
        while True:
            level, groups = level + 1, -(-groups // FAN_IN)
            place = F.pmod("part", F.lit(LEVEL))  # in its level
            group = F.floor(place / FAN_IN) if turn == "open" else F.pmod(place, F.lit(groups))
            was = bins_of(loose)
            packed = saved(by_part(loose.withColumn("g", group.cast("long") + level * LEVEL), "g", repack_group, how))
            have += bins_of(packed) - was
            if groups == 1 or have <= need:
                settled.append(packed)
                break
            settled.append(packed.filter(f"NOT {turn}"))
            loose = packed.filter(turn)
    number = F.col("part") * F.lit(BINS) + F.col("bin")
    return union(settled).select(*NAMES, number.alias("sequence_id"), "offset", (F.col("part_bins") <= F.col("part_bound")).alias("certified"), F.lit(int(have - need)).cast("long").alias("bins_above_bound"))


def pack_documents(docs: DataFrame, limit: int = SEQUENCE, ranks_path: str | None = None, part_pieces: int = PART_PIECES) -> DataFrame:
    """docs(doc_id, text) tokenised, cut and packed; see tokenized() and pack()."""
    return pack(tokenized(docs, limit, ranks_path), limit, part_pieces)
