"""Token ids of packed pieces against the tokenizer that the contract names."""

import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n", "  <|endoftext|> \t<|endoftext", "<|ENDOFTEXT|> it's 42  é\n\n", "plain", "", None, "long <|endoftext|> text " * 900]


def test_ids_equal_the_named_tokenizer(spark):
    named = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for doc, text in enumerate(TEXTS):
        ids = np.array(named.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        want += [(doc, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(packing.cut_points(len(ids), packing.SEQUENCE))]
    rows = packing.tokenized(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == want


def fits(rows: list, limit: int) -> int:
    """Checks sequences that are gapless from 0 and not too long; gives their number."""
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


def fewest(lengths: list[int], limit: int) -> int:
    """The least number of bins, by search over all packings."""
    best = len(lengths)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, limit - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_never_exceed_the_fewest_bins():
    rng = np.random.default_rng(5)
    for _ in range(60):
        limit = int(rng.integers(5, 30))
        lengths = rng.integers(1, limit + 1, int(rng.integers(1, 9))).tolist()
        least, bound = fewest(lengths, limit), packing.lower_bound(np.bincount(lengths, minlength=limit + 1), limit)
        bins, _, fill = packing.best_fit_decreasing(np.sort(lengths)[::-1], limit)
        assert bound <= least <= len(fill) <= 2 * least and fill.max() <= limit


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(spark, lengths, ids=None):
    return spark.createDataFrame([(None if ids is None else ids[i % len(ids)], 0, 0, int(n), 0) for i, n in enumerate(lengths)], PIECES)


@pytest.mark.parametrize("kind", ["documents", "even"])
def test_small_partitions_exchange_up_to_the_bound(spark, kind):
    rng = np.random.default_rng(6)
    # lengths like those of documents; and, as hard as can be, all lengths alike often
    lengths = np.clip(rng.lognormal(5.5, 1.2, 1500), 1, 2048).astype(int) if kind == "documents" else rng.integers(1, 2049, 800)
    whole = packing.pack(pieces_of(spark, lengths)).collect()
    parts = packing.pack(pieces_of(spark, lengths), part_pieces=50).collect()
    assert len(whole) == len(parts) == len(lengths)
    assert fits(parts, 2048) <= (fits(whole, 2048) + 1 if kind == "documents" else 1.03 * fits(whole, 2048))
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    assert fits(parts, 2048) - bound == parts[0].bins_above_bound


def test_null_and_repeated_ids_are_dealt_out(spark):
    rows = pieces_of(spark, [7] * 3000, [None, 5])
    seen = rows.select("*").withColumn("uid", F.monotonically_increasing_id()).select(F.pmod(F.xxhash64("uid"), F.lit(30)).alias("p")).groupBy("p").count().collect()
    assert len(seen) == 30 and max(r["count"] for r in seen) < 300
    assert fits(packing.pack(rows, 70, part_pieces=100).collect(), 70) == 300


def test_documents_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "x"), (None, "x"), (4, "é\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS length", "3 AS sequence_id", "4 AS uid")
    got = packing.pack_documents(docs).collect()
    fits(got, packing.SEQUENCE)
    assert sorted(map(str, {r.doc_id for r in got})) == ["1", "2", "3", "4", "None"] and [r.length for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * 5002 and sum(r.doc_id is None for r in got) == 2
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_bins_of_many_partitions_stay_apart(spark, monkeypatch):
    """Most pieces over half a sequence, so that a group has nearly as many bins as pieces, over several levels of groups;
    the bin numbers leave as little room as the check of sizes allows."""
    monkeypatch.setattr(packing, "BINS", packing.FAN_IN * packing.GIVE * 20 + 1)
    rng = np.random.default_rng(8)
    lengths = np.where(rng.random(192 * 20) < 0.005, 600, 1500)
    rows = packing.pack(pieces_of(spark, lengths), part_pieces=20).collect()
    assert len(rows) == len(lengths) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    assert fits(rows, 2048) - bound == rows[0].bins_above_bound >= 0
    with pytest.raises(ValueError):
        packing.pack(pieces_of(spark, lengths), part_pieces=30)


def test_a_group_larger_than_a_sequence_number_allows(spark):
    """One group of 1.3 million pieces that all need bins of their own: numbers of one partition never meet another's."""
    rows = packing.pa.table({c: np.zeros(1_300_000, np.int64) for c in packing.NAMES} | {"length": np.full(1_300_000, 1500), "uid": np.arange(1_300_000), "part": np.arange(1_300_000) // 170_000, "bin": np.arange(1_300_000) % 170_000, "offset": np.zeros(1_300_000, np.int64)})
    out = packing.repack_group(rows, 5, packing.Exchange(2048, 160_000))
    bins = out.column("bin").to_numpy()
    assert len(np.unique(bins)) == 1_300_000 and bins.max() < packing.BINS


def test_overfull_bins_are_an_error():
    rows = packing.pa.table({c: np.zeros(3, np.int64) for c in packing.NAMES} | {"length": np.full(3, 1500), "uid": np.arange(3)})
    with pytest.raises(ValueError):
        packing.with_places(rows, 0, np.array([0, 0, 1]), np.array([0, 1500, 0]), packing.Exchange(2048, 10))
