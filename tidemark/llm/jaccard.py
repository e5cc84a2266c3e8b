"""Exact similarity join of texts on word shingles.

Texts become sets of 64-bit hashes of five consecutive words; equal sets form a class
and are compared once. Two classes link when 7 * overlap >= 3 * (size + size), that
is a Jaccard similarity of 0.75 or more. The steps:

1. One pass writes size, class, a parity bitmap of one to two bits per shingle and
   band marks of every text, and adds up how often shingles of each of 2**20 slots occur.
2. Texts that share a band mark are compared with the head of that mark and of a part of
   its classes, which joins most copies into components cheaply and misses
   nothing, since step 3 is complete.
3. A second pass lists, rarest first by slot counts, the shingles of which two linked
   texts must share one (a quarter of the set and one more). Texts under one shingle
   are ordered by size and cut into tiles; pairs of tiles whose sizes can link are
   compared by bitmaps. If h bits differ, at least h shingles do, so a pair can link
   only if size + size >= 7 h. Pairs within a component of step 2 are left out.
4. What remains is decided by the exact intersection of the sorted arrays. Of any two
   components under a pair of tiles, the pair with the most alike bitmaps is decided
   first; then all pairs that still lie between components are, so none is left out.

No task holds more than two tiles, only bounded tables reach every task (the slot
levels, one byte each), and frequent shingles stand last, so passages that many texts
share lead to few comparisons.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.llm.common import fresh_name, lowered_words, runs, settle, slices, texts, tidied
from tidemark.llm.links import components

WORDS = 5
SLOT_BITS = 20
BLOCK = 1 << 14  # slots per row of a sketch
TILE = 1024  # texts per tile
MARKS = 5  # smallest hashes under as many mixings; every three of them make a band
BANDS = [(i, j, k) for i in range(MARKS) for j in range(i) for k in range(j)]
WIDEST = 1 << 15  # bits of a bitmap
PARTS = 7  # of a band's classes, each with a head of its own
ID_SLOTS = 1 << 20  # slots of ids that a scan of texts is cut to before its join
MIX = [np.uint64(int(xxhash.xxh3_64_intdigest(str(i).encode()) | 1)) for i in range(16)]


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than five make one."""
    words = lowered_words(text)
    if not words:
        return np.empty(0, np.uint64)
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(found))
    mixed = np.full(len(found) - size + 1, MIX[size + 8])
    for i in range(size):
        mixed += found[i : len(found) - size + 1 + i] * MIX[i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= MIX[8]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the shingles per bit, with at least one bit for each up to the widest."""
    width = min(WIDEST, max(64, 1 << (len(found) - 1).bit_length()))
    return np.packbits(np.bincount(found & np.uint64(width - 1), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def marks(found: np.ndarray) -> list[int]:
    least = [int((found * MIX[9 + i]).min()) for i in range(MARKS)]
    return [xxhash.xxh3_64_intdigest(str((i, j, k, least[i], least[j], least[k])).encode()) - (1 << 63) for i, j, k in BANDS]


def _class(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


SET = "doc_id long, n int, cls long, bits binary, bands array<long>, block int, counts binary"
_SET = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())]
)


def _describe(batches):
    """A row per text, and at the end of a task its slot counts, a row per block."""
    hashes, slots = WordHash(), np.zeros(1 << SLOT_BITS, np.int64)
    for batch in slices(batches):
        rows, seen = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            found = shingles(text, hashes)
            seen.append(found >> np.uint64(64 - SLOT_BITS))
            if len(found):
                rows.append((doc_id, len(found), _class(found), bitmap(found), marks(found), None, None))
            else:
                rows.append((doc_id, 0, None, None, None, None, None))
        slots += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(slots))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SET)], schema=_SET)
    if slots.any():
        for block, part in enumerate(np.minimum(slots, 65_535).astype("<u2").reshape(-1, BLOCK)):
            row = (None, None, None, None, None, block, part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SET)], schema=_SET)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, "<u2").astype(np.int64) for c in table.column("counts").to_pylist())
    level = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
    return pa.table({"block": table.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary())})


def _levels(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are: an eighth of a doubling per step, in one byte."""
    blocks = sets.where("block is not null").select("block", "counts")
    out = np.zeros((1 << SLOT_BITS) // BLOCK * BLOCK, np.uint8)
    for row in blocks.groupBy("block").applyInArrow(_add_blocks, "block int, levels binary").collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["levels"], np.uint8)
    return out


def _prefixes(levels: np.ndarray):
    def run(batches):
        hashes, emitted = WordHash(), set()
        for batch in slices(batches):
            keys, classes, sizes = [], [], []
            for text in texts(batch):
                found = shingles(text, hashes)
                n = len(found)
                if not n or (cls := _class(found)) in emitted:  # copies within a task list theirs once
                    continue
                emitted.add(cls)
                order = np.argsort(levels[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")
                keys.append(found[order[: n - (3 * n + 3) // 4 + 1]])
                classes.append(cls)
                sizes.append(n)
            if keys:
                times = [len(k) for k in keys]
                places = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                yield pa.record_batch(
                    {
                        "key": pa.array(np.concatenate(keys).view(np.int64)),
                        "cls": pa.array(np.repeat(np.array(classes, np.int64), times)),
                        "n": pa.array(np.repeat(np.array(sizes, np.int32), times)),
                        "pos": pa.array(places),
                    }
                )

    return run


def _shared(batches):
    """Of rows ordered by (key, n, cls), those whose key has another class, numbered into tiles.

    The smaller text of a linked pair has their first shared shingle among the first
    seventh of its list, so larger texts count from the first such text on.
    """
    key_before, inner_before = None, False
    held = None  # the last row is decided with the next batch: key, cls, n, pos, its place in its run
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "cls", "n", "pos")])
        key, _, n, pos = rows
        inner = pos <= n - (6 * n + 6) // 7
        run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        first_inner = np.full(run[-1] + 1, len(key))
        np.minimum.at(first_inner, run[inner], np.flatnonzero(inner))
        if inner_before and key[0] == key_before:
            first_inner[0] = -1
        key_before, inner_before = key[-1], first_inner[-1] < len(key)
        rows = rows[:, np.arange(len(key)) >= first_inner[run]]
        place = 0
        if held is not None:
            rows = np.concatenate([held[:4, None], rows], 1)
            place = held[4]
        if not rows.shape[1]:
            continue
        key, cls = rows[:2]
        rows = rows[:, np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])]
        key = rows[0]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(key))
        places = index - np.maximum.accumulate(np.where(start, index, 0))
        places[: np.flatnonzero(start)[1] if start.sum() > 1 else len(key)] += place
        several = (places > 0) | np.concatenate([~start[1:], [False]])
        held = np.append(rows[:, -1], places[-1])
        several[-1] = False
        yield _tile_rows(rows[:, several], places[several])
    if held is not None and held[4] > 0:
        yield _tile_rows(held[:4, None], held[4:])


def _tile_rows(rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    key, cls, n, pos = rows
    columns = (key, cls, n.astype(np.int32), pos.astype(np.int32), (places // TILE).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "cls", "n", "pos", "tile"])


def _fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width, wider ones with their halves added up."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width), np.uint8)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _pairs(comp, n, pos, side, same: bool):
    """Places of two rows under a pair of tiles that component, size and place let link."""
    sizes = n.astype(np.int64)
    rest = sizes - pos  # shingles from the shared one on: what a first shared one leaves to share
    right = np.arange(len(comp)) if same else np.flatnonzero(side == 1)
    left = right if same else np.flatnonzero(side == 0)
    for at in range(0, len(left), 32):
        part = left[at : at + 32]
        small = np.minimum(rest[part][:, None], rest[right][None])
        both = sizes[part][:, None] + sizes[right][None]
        can = (comp[part][:, None] != comp[right][None]) & (7 * small >= 3 * both)
        if same:
            can &= part[:, None] < right[None]
        x, y = np.nonzero(can)
        if len(x):
            yield part[x], right[y], both[x, y]


TILED = "key long, i int, j int, cls long, n int, pos int, comp long, side int"


def _possible(batches):
    """The rows that may link with another one under their pair of tiles, before bitmaps are looked at."""
    names = ["key", "i", "j", "cls", "n", "pos", "comp", "side"]
    out: list[list[np.ndarray]] = []
    held = 0
    for run in runs(batches, names[:3], names[3:]):
        _, i, j, _, n, pos, comp, side = run
        if len(comp) == 2:  # most runs
            a, b = int(n[0]), int(n[1])
            if comp[0] == comp[1] or (i[0] != j[0] and side[0] == side[1]) or 7 * min(a - pos[0], b - pos[1]) < 3 * (a + b):
                continue
        else:
            keep = np.zeros(len(comp), bool)
            for x, y, _ in _pairs(comp, n, pos, side, i[0] == j[0]):
                keep[x] = keep[y] = True
            if not keep.any():
                continue
            run = [c[keep] for c in run]
        out.append(run)
        held += len(run[0])
        if held > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def _compare(closest: bool):
    """Pairs of classes under a pair of tiles whose bitmaps let them link.

    If so asked, of every two components only the pair with the most alike bitmaps, and
    ``more`` tells whether the tiles have others.
    """
    names = ["a", "b", "key", "i", "j", "more"]

    def run(batches):
        out, held = [], 0
        for key, i, j, cls, n, pos, comp, side, bits in runs(batches, ["key", "i", "j"], ["cls", "n", "pos", "comp", "side", "bits"]):
            found, maps = [], _fold(list(bits))
            for x, y, both in _pairs(comp, n, pos, side, i[0] == j[0]):
                differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
                ok = both >= 7 * differ
                found.append((x[ok], y[ok], differ[ok]))
            if not found:
                continue
            x, y, differ = (np.concatenate(c) for c in zip(*found))
            count = len(x)
            if closest and count > 1:
                ends = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], 1)
                order = np.argsort(differ, kind="stable")
                order = order[np.unique(ends[order], axis=0, return_index=True)[1]]
                x, y = x[order], y[order]
            if len(x):
                a, b = cls[x], cls[y]
                rows = len(x)
                more = np.full(rows, count > rows)
                out.append((np.minimum(a, b), np.maximum(a, b), np.repeat(key[0], rows), np.repeat(i[0], rows), np.repeat(j[0], rows), more))
                held += rows
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def _intersect(batches):
    for batch in slices(batches, 64):
        a, b = (batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b"))
        linked = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            overlap = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(7 * overlap >= 3 * (len(x) + len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _wanted_arrays(batches):
    hashes = WordHash()
    for batch in slices(batches):
        rows = []
        for text, cls in zip(texts(batch), batch.column("cls").to_pylist()):
            found = shingles(text, hashes)
            if len(found) and _class(found) == cls:
                rows.append((cls, found.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "shingles"])


@dataclass(frozen=True)
class Joined:
    """rows (doc_id, n, cls) and classes (cls, doc_id, root, component_id); root is a component's least class."""

    rows: DataFrame
    classes: DataFrame


def join(docs: DataFrame) -> Joined:
    """Link texts of (doc_id, text) and find the components of the links.

    Null and empty texts, and those of white space only, have no shingle, no class and
    no link. Repeated rows and equal texts share a class. A class's doc_id is the least
    of its rows, null only if all are. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = settle(docs.mapInArrow(tidied(_describe), SET), "shingle-sets")
    rows = sets.where("block is null").select("doc_id", "n", "cls")
    classes = settle(
        sets.where("cls is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")),
        "shingle-classes",
    )
    placed = classes.select("cls", "doc_id", "n", "bits", F.col("cls").alias("comp"))
    placed = _merged(placed, _verified(docs, classes, _star(classes)))
    shared = _shared_shingles(docs, _levels(sets))
    nearest = settle(_compared(_tiled(shared, placed, None), placed, True), "shingle-nearest")
    placed = _merged(placed, _verified(docs, classes, nearest.select("a", "b").distinct()))
    unseen = settle(nearest.where("more").select("key", "i", "j").distinct(), "shingle-unseen")
    others = _compared(_tiled(shared, placed, unseen), placed, False)
    placed = _merged(placed, _verified(docs, classes, others.select("a", "b").distinct()))
    rooted = placed.select("cls", "doc_id", F.col("comp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return Joined(rows, settle(rooted.join(least, "root").select("cls", "doc_id", "root", "component_id"), "shingle-components"))


def _star(classes: DataFrame) -> DataFrame:
    """Each class with the head of every band mark it has, and with the head of a part of
    it, if sizes and bitmaps let them link.

    Heads are drawn by a hash of class and band, so many copies that each changed in
    their own way meet other heads under every mark.
    """
    banded = classes.select("cls", "n", F.explode("bands").alias("band"), F.pmod("cls", F.lit(PARTS)).alias("part"))
    drawn = F.min(F.struct(F.xxhash64("cls", "band").alias("draw"), "cls", "n"))
    heads = banded.groupBy("band", "part").agg(drawn.alias("own"), F.count("*").alias("size"))
    least = heads.groupBy("band").agg(F.min("own").alias("head"), F.sum("size").alias("size")).where("size > 1").select("band", "head")
    heads = settle(heads.join(least, "band").select("band", "part", "own", "head"), "shingle-heads")
    met = banded.join(heads, ["band", "part"]).select("cls", "n", F.explode(F.array_distinct(F.array("own", "head"))).alias("head"))
    pairs = (
        met.where("cls <> head.cls and 7 * least(n, head.n) >= 3 * (n + head.n)")
        .select(F.least("cls", "head.cls").alias("a"), F.greatest("cls", "head.cls").alias("b")).distinct()
    )
    ends = [classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").mapInArrow(_bounded, "a long, b long")


def _bounded(batches):
    """Pairs whose bitmaps let them link."""
    for batch in slices(batches, 1024):
        sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        differ = [
            int(np.bitwise_count(maps[0] ^ maps[1]).sum())
            for maps in (_fold(list(pair)) for pair in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(sizes >= 7 * np.array(differ, np.int64)))


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the components that the links make of their former ones."""
    comp = placed.select("cls", "comp")
    between = links.join(comp.toDF("a", "x"), "a").join(comp.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(between).withColumnRenamed("node", "comp")
    joined = placed.join(roots, "comp", "left").select("cls", "doc_id", "n", "bits", F.coalesce("root", "comp").alias("comp"))
    return settle(joined, "shingle-placed")


def _shared_shingles(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(key, cls, n, pos, tile) of the listed shingles that several classes have."""
    listed = docs.select("text").mapInArrow(tidied(_prefixes(levels)), "key long, cls long, n int, pos int")
    dealt = listed.repartition("key").sortWithinPartitions("key", "n", "cls")
    return settle(dealt.mapInArrow(tidied(_shared), "key long, cls long, n int, pos int, tile int"), "shingle-shared")


def _tiled(shared: DataFrame, placed: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Rows of shared shingles under every pair of tiles (the given ones, else all that
    sizes let link) that hold a possible link between components."""
    shared = settle(shared.join(placed.select("cls", "comp"), "cls"), "shingle-shared")
    if pairs is None:
        several = shared.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        shared = settle(shared.join(several, "key", "left_semi"), "shingle-mixed")
        tiles = shared.groupBy("key", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        pairs = settle(
            tiles.toDF("key", "i", "low_i", "high_i").join(tiles.toDF("key", "j", "low_j", "high_j"), "key")
            .where("i <= j and 7 * least(high_i, low_j) >= 3 * (least(high_i, low_j) + low_j)").select("key", "i", "j"),
            "shingle-tiles",
        )
    placed_in = lambda tile: shared.withColumnRenamed("tile", tile).join(pairs, ["key", tile])
    columns = ["key", "i", "j", "cls", "n", "pos", "comp"]
    both = placed_in("i").select(*columns, F.lit(0).alias("side")).unionAll(
        placed_in("j").where("i < j").select(*columns, F.lit(1).alias("side"))
    )
    return settle(_by_tiles(both).mapInArrow(tidied(_possible), TILED), "shingle-possible")


def _by_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _compared(tiled: DataFrame, placed: DataFrame, closest: bool) -> DataFrame:
    mapped = tiled.join(placed.select("cls", "bits"), "cls")
    return _by_tiles(mapped).mapInArrow(tidied(_compare(closest)), "a long, b long, key long, i int, j int, more boolean")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sorted arrays intersect enough; arrays are made for their texts only."""
    pairs = settle(pairs, "shingle-pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct()
    wanted = settle(classes.select("cls", F.col("doc_id").alias("id")).join(wanted, "cls"), "shingle-wanted")
    # At most ID_SLOTS numbers go to every task and keep most other texts out of the shuffle.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).alias("slot")
    near = docs.select("doc_id", "text", slot("doc_id")).join(F.broadcast(wanted.select(slot("id")).distinct()), "slot", "left_semi")
    arrays = (
        near.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "cls")
        .mapInArrow(tidied(_wanted_arrays), "cls long, shingles binary").dropDuplicates(["cls"])
    )
    arrays = settle(arrays, "shingle-arrays")
    held = pairs.join(arrays.toDF("a", "shingles_a"), "a").join(arrays.toDF("b", "shingles_b"), "b")
    return settle(held.select("a", "b", "shingles_a", "shingles_b").mapInArrow(tidied(_intersect), "a long, b long"), "shingle-links")


def _with_class(name: str):
    def run(batches):
        hashes = WordHash()
        for batch in slices(batches):
            found = (shingles(t, hashes) for t in texts(batch))
            classes = pa.array([_class(f) if len(f) else None for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], names=[*batch.schema.names, name])

    return run


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of every component stays, that of the least doc_id; all columns are kept.

    Of repeated rows of that id one stays, as does one row of a component whose ids are
    all null. Rows without shingles all stay.
    """
    heads = join(docs).classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("root")).alias("root")).agg(F.min("cls").alias("head"))
    name = fresh_name(docs, "shingle_class")
    classed = docs.mapInArrow(tidied(_with_class(name)), StructType([*docs.schema.fields]).add(name, LongType()))
    first = classed.join(
        heads.select("head", "component_id"),
        (F.col(name) == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("component_id")), "left_semi",
    ).dropDuplicates([name])
    return first.unionAll(classed.where(F.col(name).isNull())).drop(name)
