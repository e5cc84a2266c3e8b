"""Best-fit decreasing packing in partitions, certified by lower bounds, with exchanges.

Pieces are dealt into partitions of bounded size and a task packs each by best-fit
decreasing. Dual feasible functions bound from below how many sequences a partition needs.
What a partition has above its bound is its gap; it releases its emptiest sequences, as
many as could close the gap, and keeps the others. The released documents of all
partitions are dealt anew into fewer ones, where they meet others, and packed again by
the same rule, until the number of sequences is certified over all pieces, nothing is
gained any more, or one partition is left. A round's rows are written before the next
one, so a lost executor repeats one partition.

Only sizes decide, so the certificate over all pieces needs their counts by size alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from tidemark.llm.common import fresh_name, portions, settle, texts
from tidemark.llm.packing import Encoder

CELL_PIECES = 131_072
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, longest: int = 2048) -> DataFrame:
    """Pieces of every row of (doc_id, text): its ids and an end id, cut only if longer than ``longest``.

    Null and empty texts are one piece that holds the end id. Repeated rows and null ids
    are cut like any other row; no rows, no pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in portions(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(encoder.encode(text), np.uint32(END)).astype("<u4")
                for number, at in enumerate(range(0, len(ids), longest)):
                    part = ids[at : at + longest]
                    rows.append((doc_id, number, at, len(part), zlib.crc32(part.tobytes())))
            columns = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """The best of several dual feasible bounds on sequences, ``counts[x]`` pieces having x tokens.

    Such a function maps sizes so that pieces that fit into one sequence never add up to
    more than one; so the sum over all pieces is a bound. Used are, for each threshold t:
    sizes above capacity - t as whole and those below t as nothing; sizes rounded down to
    k-ths at (k + 1)-ths; and sizes above one half rounded up to multiples of t. Sums are
    of whole numbers, so nothing is lost by rounding.
    """
    sizes = np.flatnonzero(counts).astype(np.int64)
    n = counts[sizes].astype(np.int64)
    if not len(sizes):
        return 0.0
    best = float(n @ sizes) / capacity
    half = capacity // 2
    for t in range(1, half + 1):
        cut = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, float(n @ cut) / capacity)
        steps = capacity // t  # multiples of t in a whole sequence
        rounded = np.where(2 * sizes > capacity, 2 * (steps - (capacity - sizes) // t), np.where(2 * sizes == capacity, steps, 2 * (sizes // t)))
        best = max(best, float(n @ rounded) / (2 * steps))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        stepped = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, float(n @ stepped) / (k * capacity))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, largest pieces first, and what each sequence has left.

    A piece goes where least is left over; of equal ones, to the last that came to that.
    The room left is at most ``capacity``, so the search is for a bit of one number.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some sequence has r left
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = values[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            chosen, room = len(left), capacity
            left.append(room)
        bins[i], offsets[i] = chosen, capacity - room
        room -= size
        left[chosen] = room
        if not by_room.setdefault(room, []):
            rooms |= 1 << room
        by_room[room].append(chosen)
    return bins, offsets, np.array(left, np.int64)


def _packed(items: DataFrame, n_items: int, capacity: int, turn: int) -> DataFrame:
    """One round: items with sequence_id, offset and released, those columns replaced if there."""
    cells = max(1, -(-n_items // CELL_PIECES))
    items = items.drop("sequence_id", "offset", "released")
    names, cell_name = [*items.columns], fresh_name(items, "cell")
    # where a row lies deals it, so that rows alike in all columns are spread as well
    dealt = items.withColumn(cell_name, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(cells)))
    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType()).add("released", BooleanType())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in names if c != "length")])
        sizes = table.column("length").to_numpy()
        bins, offsets, left = best_fit(sizes, capacity)
        gap = len(left) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        emptiest = np.argsort(-left, kind="stable")[: int(np.ceil(gap)) + 1]
        released = np.isin(bins, emptiest) if cells > 1 else np.zeros(len(bins), bool)
        first = (turn << 58) | (table.column(cell_name)[0].as_py() << 20)
        out = table.select(names).append_column("sequence_id", pa.array(bins + first))
        return out.append_column("offset", pa.array(offsets)).append_column("released", pa.array(released))

    return dealt.groupBy(cell_name).applyInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 2048, rounds: int = 16) -> DataFrame:
    """Items (with a column ``length`` of 1 to ``capacity``) with sequence_id and offset.

    Documents are exchanged in at most ``rounds`` rounds.

    All other columns are kept; items of full length have a sequence alone. Of items of
    one size any may take the other's place; repeated rows are items each. No items, no
    sequences.
    """
    items = settle(items, "repacking-items")
    alone = items.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    rest = items.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rest.groupBy("length").count().collect():  # one row a size, ``capacity`` at most
        counts[size] = n
    bound, n_items = int(np.ceil(lower_bound(counts, capacity) - 1e-9)), int(counts.sum())
    done, kept, pool, before, turn = alone, 0, rest, None, 0
    while n_items:
        packed = settle(_packed(pool, n_items, capacity, turn), f"repacking-{turn}")
        first = F.col("offset") == 0
        now = packed.agg(
            F.count_if(first).alias("all"), F.count_if(first & F.col("released")).alias("released"), F.count_if("released").alias("items")
        ).first()
        if before is not None and now["all"] >= before:  # nothing gained: the sequences of the round before stay
            done = done.unionByName(pool.drop("released"))
            break
        if kept + now["all"] == bound or not now["items"] or turn == rounds:
            done = done.unionByName(packed.drop("released"))
            break
        done = done.unionByName(packed.where(~F.col("released")).drop("released"))
        kept += now["all"] - now["released"]
        pool, n_items, before, turn = packed.where("released"), now["items"], now["released"], turn + 1
    return done


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences of packed rows, and the bound below which no packing of them can go."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in packed.groupBy("length").count().collect():  # one row a size
        counts[size] = n
    return packed.where("offset = 0").count(), int(np.ceil(lower_bound(counts, capacity) - 1e-9))
