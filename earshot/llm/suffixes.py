"""Repeated passages by sorting suffixes.

A suffix of LENGTH bytes is compared only with those that share its anchor: the LEAD bytes in it that hash lowest (the
leftmost of them). Equal suffixes have equal anchors at equal places, so this loses none, and one anchor stands for all
neighbouring suffixes that it owns. Texts are dealt into blocks; anchors are range-partitioned by their leading tokens
(eight bytes each) at sampled splitters, buckets sort them by multikey quicksort, and buckets never part equal leads:

1. every block sends each of its distinct leads once, with its smallest document and whether it is the only one;
   buckets answer which leads are in several documents;
2. for those, every block sends each distinct record (lead, what follows it and what precedes it, as far as suffixes
   that the anchor owns reach) once, with its smallest document. Buckets sort the records, read off neighbours how far
   two can agree at most on each side, sort the suffixes which that leaves, and answer by a bit for each suffix that
   also starts in a smaller document. What lies on both sides of a bucket's boundary is not equal, and the suffixes of
   one block meet those of another only here: bytes decide throughout, never hashes.

A passage in very many documents is thus one record a block, however often the block has it. A lead with very many
anchors (runs of blanks, say) may have as many different records, which no bucket should hold: its records are sent as
their suffixes, each distinct one once a block, in the order of a hash of all their bytes, and buckets of that order compare
the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import saved

LENGTH, LEAD = 50, 16
#: Places for an anchor in a suffix, and bytes that a suffix may have before or after its anchor.
WINDOW = LENGTH - LEAD + 1
SIDE = LENGTH - LEAD
#: Bytes of a block, rows of a bucket, and anchors from which on the records of a lead are parted by suffix.
BLOCK_BYTES, BUCKET_ROWS, HOT_ANCHORS = 8 << 20, 500_000, 100_000
#: Suffixes of an anchor, about; buckets of suffixes are planned by it.
OWNED = 18
#: Bytes of text sampled for splitters: per bucket, at least, and at most.
SAMPLE_BUCKET, SAMPLE_LEAST, SAMPLE_MOST = 40_000, 2 << 20, 64 << 20
MIX, MIX2 = 0x9E3779B1, 0x85EBCA77
#: Suffixes whose hashes are in a processor's cache at once; their places have 16 bits.
PIECE = (1 << 16) - 64
#: A record: lead, what follows, what precedes (backwards), the lengths of both, in whole tokens.
RECORD = 88
#: A suffix of a hot lead: its hash, then all its bytes.
SUFFIX = 8 + LENGTH
CHUNK = "bucket int, block int, first long, keys binary, docs binary, counts binary"
TOLD = "block int, part int, hot long, places binary, bits binary"


def tokens(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big-endian tokens."""
    short = -rows.shape[1] % 8
    whole = np.pad(rows, ((0, 0), (0, short))) if short else np.ascontiguousarray(rows)
    return list(np.ascontiguousarray(whole.view(">u8").astype(np.uint64).T))


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by keys[0], then keys[1], ...: only runs that are still equal are sorted by the next key."""
    order = np.argsort(keys[0], kind="stable")
    starts, ends = runs([keys[0]], order)
    for depth in range(1, len(keys)):
        many = ends - starts > 1
        if not many.any():
            break
        inside = np.repeat(many, ends - starts)
        group = np.repeat(np.arange(len(starts)), ends - starts)[inside]
        rows = order[inside]
        order[inside] = rows[np.lexsort((keys[depth][rows], group))]
        starts, ends = runs(keys[: depth + 1], order)
    return order


def runs(keys: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal keys in an order."""
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        own = k[order]
        change[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(change)
    return starts, np.r_[starts[1:], len(order)]


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of width neighbours from each place."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts of given sizes that follow one another in x: place, first and last suffix that it owns."""
    inside = np.ones(len(x), bool)  # whether a suffix from here ends in its text
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        inside[max(start, end - LENGTH + 1) : end] = False
    found = []
    for start in range(0, max(len(x) - LENGTH + 1, 0), PIECE):
        part = x[start : start + PIECE + LENGTH - 1]
        h = (part.astype(np.uint32) ^ np.uint32(0x5A)) * np.uint32(MIX2)
        width = 1
        while width < LEAD:
            h = h[:-width] * np.uint32(pow(MIX, width, 1 << 32)) + h[width:]
            width *= 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(MIX2)
        # half of the hash, then the place: the smallest is the leftmost of those that hash lowest
        own = lowest((h & np.uint32(0xFFFF0000)) | np.arange(len(h), dtype=np.uint32), WINDOW) & np.uint32(0xFFFF)
        at = np.flatnonzero(inside[start : start + len(own)])
        own = own[at]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else at
        last = np.r_[first[1:], len(own)] - 1 if len(own) else at
        found.append(np.stack([own[first], at[first], at[last]]).astype(np.int64) + start)
    place, begin, end = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    if len(place):  # an anchor of two pieces is one
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        place, begin, end = place[first], begin[first], np.maximum.reduceat(end, first)
    return place, begin, end


class Block:
    """The anchors of a block's texts, and their distinct leads in order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.x = np.frombuffer(b"".join(texts), np.uint8)
        self.place, self.begin, self.end = anchors(self.x, self.sizes)
        self.row = np.searchsorted(np.cumsum(self.sizes), self.place, side="right")
        self.doc = ids[self.row] if len(ids) else np.zeros(0, np.int64)
        lead = self.around(0, LEAD, self.place)
        self.leads, self.of, self.low, self.many = grouped(lead, self.doc)
        self.anchors_of = np.bincount(self.of, minlength=len(self.leads))

    def around(self, before: int, after: int, place: np.ndarray) -> np.ndarray:
        """Bytes from `before` ahead of each place to `after` behind it; zeros beyond the block."""
        if not len(place):
            return np.zeros((0, before + after), np.uint8)
        wide = np.concatenate([np.zeros(before, np.uint8), self.x, np.zeros(after, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(wide, before + after)[place]

    def records(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of shared leads: their numbers, the distinct records in order, each anchor's record, each record's
        smallest document, and whether its lead is hot, as `hot` says of shared."""
        pick = np.flatnonzero(np.isin(self.of, shared))
        place = self.place[pick]
        bytes_ = self.around(SIDE, LENGTH, place)
        before, after = place - self.begin[pick], self.end[pick] + LENGTH - LEAD - place
        side = np.arange(SIDE)
        out = np.zeros((len(pick), RECORD), np.uint8)
        out[:, :LEAD] = bytes_[:, SIDE : SIDE + LEAD]
        out[:, LEAD:LENGTH] = np.where(side < after[:, None], bytes_[:, SIDE + LEAD :], 0)
        out[:, LENGTH : LENGTH + SIDE] = np.where(side < before[:, None], bytes_[:, SIDE - 1 :: -1], 0)
        out[:, LENGTH + SIDE], out[:, LENGTH + SIDE + 1] = after, before
        distinct, of, low, _ = grouped(out, self.doc[pick])
        heat, is_hot = np.zeros(len(self.leads), bool), np.zeros(len(distinct), bool)
        heat[shared[hot]] = True
        is_hot[of] = heat[self.of[pick]]
        return pick, distinct, of, low, is_hot


def suffixes(kinds: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of some records: SUFFIX rows, the record of each and the bytes it has before the anchor."""
    after, before = kinds[:, LEAD:LENGTH], kinds[:, LENGTH : LENGTH + SIDE]
    n_after, n_before = kinds[:, LENGTH + SIDE].astype(np.int64), kinds[:, LENGTH + SIDE + 1].astype(np.int64)
    rows, of, places = [np.zeros((0, LENGTH), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(WINDOW):
        have = some[(SIDE - n_after[some] <= k) & (k <= n_before[some])]
        rows.append(np.concatenate([before[have, :k][:, ::-1], kinds[have, :LEAD], after[have, : SIDE - k]], axis=1))
        of.append(have)
        places.append(np.full(len(have), k))
    found = np.concatenate(rows)
    mixed = np.zeros(len(found), np.uint64)
    for token in tokens(found):
        mixed = (mixed ^ token) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.concatenate([mixed.astype(">u8").view(np.uint8).reshape(-1, 8), found], axis=1), np.concatenate(of), np.concatenate(places)


def grouped(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, the number of each row among them, the smallest doc of each and whether it has others."""
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    keys = tokens(rows)
    order = multikey_sort(keys)
    starts, ends = runs(keys, order)
    of = np.empty(len(rows), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), ends - starts)
    low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
    return rows[order[starts]], of, low, low != high


def strings(rows: np.ndarray) -> np.ndarray:
    """The leading LEAD bytes of rows, as strings that compare like them."""
    return np.ascontiguousarray(rows[:, :LEAD]).view(f"S{LEAD}").ravel()


def lead_buckets(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, strings(rows), side="right") if len(rows) else np.zeros(0, np.int64)


def suffix_buckets(rows: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of SUFFIX rows, below zero: as many ranges of their hashes."""
    high = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
    return -1 - (high * buckets >> 32)


def chunks(block: int, rows: np.ndarray, low: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """CHUNK rows, one for each bucket that some of the (sorted) rows of a block belong to."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else bucket
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(rows)]))
    binary = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
    numbers = [pa.array(bucket[first], pa.int32()), pa.array([block] * len(spans), pa.int32()), pa.array(first, pa.int64())]
    return pa.table([*numbers, binary(rows), binary(low), binary(counts)], names=["bucket", "block", "first", "keys", "docs", "counts"])


def joined(table: pa.Table, column: str, kind: type, width: int = 1) -> np.ndarray:
    out = np.frombuffer(b"".join(table.column(column).to_pylist()), kind)
    return out.reshape(-1, width) if width > 1 else out


def told(table: pa.Table, width: int, part: int, pick: np.ndarray, bits: np.ndarray) -> pa.Table:
    """TOLD rows for the blocks of a bucket's chunks: the numbers that picked rows have in their block, and bits."""
    sizes = np.array([len(k) // width for k in table.column("keys").to_pylist()], np.int64)
    begin = np.cumsum(sizes) - sizes
    chunk = np.searchsorted(begin + sizes, pick, side="right")
    number = table.column("first").to_numpy()[chunk] + pick - begin[chunk]
    cuts = np.searchsorted(chunk, np.arange(len(sizes) + 1))
    some = [i for i in range(len(sizes)) if cuts[i] < cuts[i + 1]]
    binary = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
    hot = pa.array([int(bits[cuts[i] : cuts[i + 1]].sum()) if part == 0 else 0 for i in some], pa.int64())
    return pa.table([table.column("block").take(pa.array(some, pa.int64())).cast(pa.int32()), pa.array([part] * len(some), pa.int32()), hot, binary(number), binary(bits)], names=["block", "part", "hot", "places", "bits"])


def shared_leads(table: pa.Table, hot_anchors: int) -> pa.Table:
    """Of the leads of a bucket: those in several documents. Where one has over hot_anchors anchors in all, with how many
    of them are in the block, else with 0. A count below zero says that a block has the lead in several documents."""
    keys = tokens(joined(table, "keys", np.uint8, LEAD))
    doc, counts = joined(table, "docs", np.int64), joined(table, "counts", np.int64)
    order = multikey_sort(keys)
    starts, ends = runs(keys, order)
    several = np.logical_or.reduceat(counts[order] < 0, starts) | (np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts))
    pick = np.sort(order[np.repeat(several, ends - starts)])
    hot = np.empty(len(order), bool)
    hot[order] = np.repeat(np.add.reduceat(np.abs(counts[order]), starts) > hot_anchors, ends - starts)
    return told(table, LEAD, 0, pick, np.where(hot, np.abs(counts), 0)[pick].astype(np.uint64))


def smaller_elsewhere(table: pa.Table) -> pa.Table:
    """Of the suffixes of a bucket: those that another block has in a smaller document."""
    keys, doc = tokens(joined(table, "keys", np.uint8, SUFFIX)), joined(table, "docs", np.int64)
    order = multikey_sort(keys)
    starts, ends = runs(keys, order)
    low = np.empty(len(order), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(doc[order], starts), ends - starts)
    pick = np.flatnonzero(low < doc)
    return told(table, SUFFIX, 2, pick, np.zeros(len(pick), np.uint64))


def agreement(rows: np.ndarray, same_run: np.ndarray) -> np.ndarray:
    """Leading bytes that each of some sorted rows shares at most with another of its run."""
    differ = rows[1:] != rows[:-1]
    common = np.where(same_run, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]), 0)
    return np.maximum(np.r_[0, common], np.r_[common, 0])


def repeated_suffixes(table: pa.Table) -> pa.Table:
    """Of the records of a bucket: a bit for each suffix (by the bytes it has before the anchor) that also starts in a
    document smaller than the record's smallest in its block."""
    rows, doc = joined(table, "keys", np.uint8, RECORD), joined(table, "docs", np.int64)
    keys = tokens(rows)
    order = multikey_sort(keys)
    starts, ends = runs(keys, order)
    kinds, low = rows[order[starts]], np.minimum.reduceat(doc[order], starts)
    of = np.empty(len(rows), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), ends - starts)
    lead = tokens(kinds[:, :LEAD])
    same = (lead[0][1:] == lead[0][:-1]) & (lead[1][1:] == lead[1][:-1])
    run = np.cumsum(np.r_[0, ~same])[: len(kinds)]
    after, before = kinds[:, LEAD:LENGTH], kinds[:, LENGTH : LENGTH + SIDE]
    n_after, n_before = kinds[:, LENGTH + SIDE].astype(np.int64), kinds[:, LENGTH + SIDE + 1].astype(np.int64)
    back = multikey_sort([run, *tokens(before)])
    reach = np.empty(len(kinds), np.int64)
    reach[back] = agreement(before[back], run[back][1:] == run[back][:-1])
    least = SIDE - np.minimum(n_after, agreement(after, same))
    most = np.minimum(n_before, reach)
    alone = ~(np.r_[False, same] | np.r_[same, False])
    bits = np.zeros(len(kinds), np.uint64)
    for k in range(WINDOW):
        some = np.flatnonzero((least <= k) & (k <= most) & ~alone)
        if len(some) < 2:
            continue
        parts = [run[some], *tokens(np.concatenate([after[some, : SIDE - k], before[some, :k]], axis=1))]
        sort = multikey_sort(parts)
        a, b = runs(parts, sort)
        smallest = np.repeat(np.minimum.reduceat(low[some[sort]], a), b - a)
        bits[some[sort[smallest < low[some[sort]]]]] |= np.uint64(1 << k)
    all_bits = (np.uint64(1) << (n_before + 1).astype(np.uint64)) - (np.uint64(1) << (SIDE - n_after).astype(np.uint64))
    own = np.where(doc > low[of], all_bits[of], bits[of])
    pick = np.flatnonzero(own)
    return told(table, RECORD, 1, pick, own[pick])


def numbers(table: pa.Table, part: int) -> tuple[np.ndarray, np.ndarray]:
    mine = table.filter(pc.equal(table.column("part"), part))
    return joined(mine, "places", np.int64), joined(mine, "bits", np.uint64)


def ids_and_texts(rows: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return rows.column("doc_id").to_numpy(), [t.encode() for t in rows.column("text").to_pylist()]


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Unions of [start, end) that overlap or touch, in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[first].tolist(), reach[np.r_[first[1:], len(starts)] - 1].tolist()))


def cuts(ids: np.ndarray, texts: list[bytes], answers: pa.Table) -> list[list[tuple[int, int]]]:
    """The spans to remove from each text of a block."""
    block = Block(ids, texts)
    shared, heat = numbers(answers, 0)
    pick, kinds, of, low, hot = block.records(shared, heat > 0)
    bits = np.zeros(len(kinds), np.uint64)
    place, found = numbers(answers, 1)
    bits[np.flatnonzero(~hot)[place]] = found
    rows, record, k = suffixes(kinds, np.flatnonzero(hot))
    _, suffix, smallest, _ = grouped(rows, low[record])
    elsewhere = np.zeros(len(smallest), bool)
    elsewhere[numbers(answers, 2)[0]] = True
    gone = elsewhere[suffix] | (smallest[suffix] < low[record]) if len(rows) else np.zeros(0, bool)
    np.bitwise_or.at(bits, record[gone], np.uint64(1) << k[gone].astype(np.uint64))
    begin, end, anchor = block.begin[pick], block.end[pick], block.place[pick]
    later = block.doc[pick] > low[of] if len(pick) else np.zeros(0, bool)
    starts, stops = [begin[later]], [end[later] + LENGTH]
    some = np.flatnonzero(~later & (bits[of] != 0)) if len(pick) else np.zeros(0, np.int64)
    for k in range(WINDOW):
        at = some[(bits[of[some]] >> np.uint64(k)) & np.uint64(1) == 1]
        starts.append(anchor[at] - k)
        stops.append(anchor[at] - k + LENGTH)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    offsets = np.cumsum(block.sizes) - block.sizes
    all_starts, all_stops = np.concatenate(starts), np.concatenate(stops)
    row = np.searchsorted(offsets + block.sizes, all_starts, side="right")
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(texts) + 1))
    for r in np.unique(row).tolist():
        mine = order[edges[r] : edges[r + 1]]
        out[r] = merged(all_starts[mine] - offsets[r], all_stops[mine] - offsets[r])
    return out


def splitters_of(texts: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Leads that part all leads into about equal buckets, from a sample of documents."""
    wanted = min(max(buckets * SAMPLE_BUCKET, SAMPLE_LEAST), SAMPLE_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = [Block(np.zeros(1, np.int64), [t.encode()]).leads.tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(leads)], pa.binary())], names=["leads"])

    sample = texts if size <= wanted else texts.sample(wanted / size, 1)
    raw = b"".join(r["leads"] for r in sample.select("text").mapInArrow(run, "leads binary").collect())
    found = np.sort(np.frombuffer(raw, f"S{LEAD}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS, hot_anchors: int = HOT_ANCHORS) -> DataFrame:
    """doc_id, spans (array of start, end in bytes, maximal and in order) and kept (binary, the other bytes) of each row.

    A byte goes where LENGTH bytes that cover it also start in a document of smaller doc_id. A null text counts as
    empty; a null doc_id is smaller than none, so its row neither loses bytes nor takes any from others; rows of one
    doc_id, alike or not, take nothing from each other, and each loses what smaller ones hold; an empty table gives an
    empty table; other columns are ignored; a lead of any heat gives the same result. Equal rows go to one block; a text longer than a block is one by itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // block_bytes + 1)).cast("int"))
    texts = rows.filter("doc_id IS NOT NULL")
    splitters = spark.sparkContext.broadcast(splitters_of(texts, size, size // OWNED // bucket_rows + 1))  # an anchor for OWNED bytes

    def send_leads(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(*ids_and_texts(rows))
        counts = np.where(block.many, -block.anchors_of, block.anchors_of)
        return chunks(key[0].as_py(), block.leads, block.low, counts, lead_buckets(block.leads, splitters.value))

    leads = texts.groupBy("block").applyInArrow(send_leads, CHUNK)
    shared = saved(leads.groupBy("bucket").applyInArrow(lambda rows: shared_leads(rows, hot_anchors), TOLD))
    suffix_ranges = (shared.agg(F.sum("hot")).first()[0] or 0) * OWNED // bucket_rows + 1

    def send_records(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(*ids_and_texts(rows))
        shared, heat = numbers(answers, 0)
        _, kinds, _, low, hot = block.records(shared, heat > 0)
        cold, none = np.flatnonzero(~hot), np.zeros(0, np.int64)
        parted, record, _ = suffixes(kinds, np.flatnonzero(hot))
        parted, _, smallest, _ = grouped(parted, low[record])
        whole = chunks(key[0].as_py(), kinds[cold], low[cold], none, lead_buckets(kinds[cold], splitters.value))
        return pa.concat_tables([whole, chunks(key[0].as_py(), parted, smallest, none, suffix_buckets(parted, suffix_ranges))])

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        return smaller_elsewhere(rows) if key[0].as_py() < 0 else repeated_suffixes(rows)

    records = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_records, CHUNK)
    answers = saved(records.groupBy("bucket").applyInArrow(answer, TOLD))

    def cut(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        named = rows.filter(pc.is_valid(rows.column("doc_id")))
        rows = pa.concat_tables([named, rows.filter(pc.is_null(rows.column("doc_id")))])
        ids, texts = ids_and_texts(named)
        spans = cuts(ids, texts, answers) + [[]] * (len(rows) - len(named))
        left = []
        for text, own in zip(rows.column("text").to_pylist(), spans):
            raw = text.encode()
            edges = [0, *(e for s in own for e in s), len(raw)]
            left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        lists = pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], kind)
        return pa.table([rows.column("doc_id"), lists, pa.array(left, pa.binary())], names=["doc_id", "spans", "kept"])

    all_told = shared.unionByName(answers)
    return rows.groupBy("block").cogroup(all_told.groupBy("block")).applyInArrow(cut, "doc_id long, spans array<struct<start: long, end: long>>, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, from deduplicated()."""
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return deduplicated(docs, **options).select("doc_id", (F.length("kept") + cut).cast("long").alias("n_bytes"), cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
