"""Bounds and packing against an exhaustive search, exchanges between partitions, ids, odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import repacking
from tidemark.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """Exhaustive search."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            left = [*rooms]
            left.remove(room)
            place(i + 1, [*left, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_bounds_hold_and_are_mostly_reached():
    rng, tight = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([7, 10, 12, 20, 30, 64])
        sizes = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 8))]
        need, bound = fewest(sizes, capacity), np.ceil(repacking.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) - 1e-9)
        assert bound <= need
        tight += bound == need
        bins, offsets, left = repacking.best_fit(np.array(sizes), capacity)
        assert need <= len(left) <= np.ceil(11 / 9 * need + 2 / 3)  # the worst that best-fit decreasing does
        for b in range(len(left)):
            inside = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
            ends = np.cumsum([s for _, s in inside])
            assert [o for o, _ in inside] == [0, *ends[:-1]] and ends[-1] == capacity - left[b]
    assert tight > 280


def valid(packed, capacity):
    for _, sequence in packed.groupby("sequence_id"):
        lengths = sequence.sort_values("offset")
        assert list(lengths.offset) == [0, *np.cumsum(lengths.length)[:-1]] and lengths.length.sum() <= capacity


def test_partitions_exchange(spark, monkeypatch):
    monkeypatch.setattr(repacking, "CELL_PIECES", 200)
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 30, 40, 55, 61, 100])) for i in range(6_000)]
    items = spark.createDataFrame(rows, "doc_id long, length long")
    packed = repacking.pack(items, 100).toPandas()
    valid(packed, 100)
    assert sorted(zip(packed.doc_id, packed.length)) == sorted(rows)
    bins, _, left = repacking.best_fit(np.array([n for _, n in rows]), 100)
    alone = repacking._packed(items.where("length < 100"), 6_000, 100, 0).where("offset = 0").count() + sum(n == 100 for _, n in rows)
    assert packed.sequence_id.nunique() < alone and packed.sequence_id.nunique() <= 1.02 * len(left)
    assert packed.sequence_id.max() >= 1 << 58


def test_certified_at_once(spark):
    items = spark.createDataFrame([(i, 10) for i in range(1_000)], "doc_id long, length long")
    assert repacking.certificate(repacking.pack(items, 100), 100) == (100, 100)


def test_rows_alike_are_spread(spark, monkeypatch):
    monkeypatch.setattr(repacking, "CELL_PIECES", 100)
    items = spark.createDataFrame([(7, 30)] * 2_000, "doc_id long, length long").repartition(4)
    cells = repacking._packed(items, 2_000, 100, 0).selectExpr("sequence_id >> 20 AS cell").groupBy("cell").count().toPandas()
    assert len(cells) == 20 and cells["count"].max() < 160


def test_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_best_fit_packing"](spark, sf_dir)
    n, bound = repacking.certificate(found)
    found = found.toPandas()
    assert n == found.sequence_id.nunique() <= bound + 1
    valid(found, 2048)
    assert len(docs) == found.doc_id.nunique()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want = [(k, k * 2048, ids[k * 2048 : (k + 1) * 2048]) for k in range(-(-len(ids) // 2048))]
        rows = found[found.doc_id == doc_id].sort_values("piece")
        assert list(zip(rows.piece, rows.start, rows.length, rows.ids_crc32)) == [
            (k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, s, part in want
        ]


def test_odd_tables(odd, none, odd_rows):
    cut = repacking.pieces(odd, WORDS)
    assert {r["length"] for r in cut.where("doc_id in (4, 5, 6)").collect()} == {1}
    packed = repacking.pack(cut).toPandas()
    valid(packed, 2048)
    assert len(packed) == cut.count() and packed.doc_id.isna().sum() == 2
    assert repacking.pack(repacking.pieces(none, WORDS)).count() == 0
    assert repacking.certificate(repacking.pieces(none, WORDS).selectExpr("*", "0 AS offset")) == (0, 0)


@pytest.mark.parametrize("sizes", [[], [2048, 2048, 2047, 1], [1] * 4_096])
def test_ends_of_the_range(spark, sizes):
    packed = repacking.pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long"))
    assert repacking.certificate(packed) == (-(-sum(sizes) // 2048),) * 2
