"""Exact k nearest binary codes by incremental multi-index hashing.

Distinct codes are dealt into shards of bounded size, queries into blocks; each block
meets each shard in packed form, as one row. A task cuts the codes of its shard into
segments of about log2 of their number in bits and keeps, per segment, the codes ordered
by its value. It then grows the search radius of one segment after the other: with
segments 0 to a searched at radius r and the others at r - 1, every code within distance
r * segments + a has been met, since some segment of it differs by no more than was
searched. A query is done once its k-th verified distance lies within that, ties included.

A step whose flips are more than the shard has codes verifies all of these instead, so a
query never costs more than a look at every code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import settle

BITS = 64
SHARD_CODES = 1 << 16
BLOCK_QUERIES = 2048
PROBES = 1 << 20  # buckets looked up at a time


def sign_code(vector: Column) -> Column:
    """Bit i is set if component i (of the first 64) is above zero; null for a null vector."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@lru_cache(maxsize=64)
def _flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.uint64)


class Index:
    """The codes of one shard, by the values of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        segments = -(-BITS // max(4, round(np.log2(max(len(codes), 2)))))
        cuts = np.linspace(0, BITS, segments + 1).astype(int)
        self.segments = [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]
        self.order, self.starts = [], []
        for at in range(segments):
            values = self.values(codes, at).astype(np.int64)
            self.order.append(np.argsort(values, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << self.segments[at][1]))]))

    def values(self, codes: np.ndarray, at: int) -> np.ndarray:
        shift, width = self.segments[at]
        return (codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def met(self, queries: np.ndarray, at: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, code), as places, whose segment ``at`` differs by exactly ``radius`` bits."""
        masks, own = _flips(self.segments[at][1], radius), self.values(queries, at)
        starts, order = self.starts[at], self.order[at]
        step = max(1, PROBES // max(1, len(masks)))
        for first in range(0, len(queries), step):
            part = own[first : first + step]
            values = (part[:, None] ^ masks).astype(np.int64).ravel()
            low = starts[values]
            sizes = starts[values + 1] - low
            ends = np.cumsum(sizes)
            if not ends[-1]:
                continue
            places = np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)
            yield first + np.repeat(np.arange(len(values)) // len(masks), sizes), order[places]


def _nearest(query: np.ndarray, code: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of pairs, once each: per query all at least as near as its k-th, nearest first."""
    order = np.lexsort((code, distance, query))
    query, code, distance = query[order], code[order], distance[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (code[1:] != code[:-1])
    query, code, distance = query[new], code[new], distance[new]
    first = np.searchsorted(query, query)
    last = np.minimum(first + k - 1, np.searchsorted(query, query, side="right") - 1)
    near = distance <= distance[last]
    return query[near], code[near], distance[near]


def search(index: Index, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance), as places, of all codes of the shard at least as near as the k-th."""
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    pending, segments, total = np.arange(len(queries)), len(index.segments), len(index.codes)
    step, kth = 0, np.full(len(queries), BITS)
    while len(pending):
        radius, at = divmod(step, segments)
        width = index.segments[at][1]
        found = [best]
        scan = sum(comb(w, radius) for _, w in index.segments[: at + 1]) > total or radius > width
        if scan:
            rows = max(1, PROBES // total)
            places = (np.meshgrid(pending[i : i + rows], np.arange(total), indexing="ij") for i in range(0, len(pending), rows))
            pairs = ((a.ravel(), b.ravel()) for a, b in places)
        else:
            pairs = ((pending[a], b) for a, b in index.met(queries[pending], at, radius))
        for query, code in pairs:
            distance = np.bitwise_count(queries[query] ^ index.codes[code]).astype(np.int64)
            near = distance <= kth[query]
            found.append(_nearest(query[near], code[near], distance[near], k))
        best = _nearest(*(np.concatenate(c) for c in zip(*found)), k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) >= k)
        kth[full] = best[2][np.searchsorted(best[0], full) + k - 1]
        covered = BITS if scan else radius * segments + at
        pending = pending[kth[pending] > covered]
        step += 1
    return best


def _packed(codes: DataFrame, column: str, number: str, size: int) -> tuple[DataFrame, int]:
    """Distinct codes as rows of some ``size`` of them, and the number of rows."""
    parts = max(1, -(-codes.count() // size))
    dealt = codes.groupBy(F.pmod(F.xxhash64(column), F.lit(parts)).cast("int").alias(number))
    return dealt.agg(F.sort_array(F.collect_list(column)).alias(f"{number}_codes")), parts  # ``size`` longs


def top_k(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest of ``base`` (id, code), ties by id.

    ``queries`` are (query_id, code). Equal codes are searched once and keep their k
    least ids, which is all that a result can hold of them. Rows with a null id or code
    are left out; repeated rows count once; fewer than k base rows give fewer ranks, none
    of them no rows.
    """
    base = base.where("id is not null and code is not null").select("id", "code").distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    held = settle(base.withColumn("place", place).where(F.col("place") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = settle(queries.where("query_id is not null and code is not null").select("query_id", "code").distinct(), "code-queries")
    shards, n_shards = _packed(held.select("code"), "code", "shard", SHARD_CODES)
    blocks, _ = _packed(asked.select(F.col("code").alias("q")).distinct(), "q", "block", BLOCK_QUERIES)
    # the packed rows of both sides are of bounded size, but not their number: a merge join, never a broadcast
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    pairs = sent.join(shards.hint("merge"), "shard")

    def run(pair: pa.Table) -> pa.Table:
        codes, wanted = (pair.column(c).combine_chunks().values.to_numpy().view(np.uint64) for c in ("shard_codes", "block_codes"))
        query, code, distance = search(Index(codes), wanted, k)
        columns = [pa.array(wanted[query].view(np.int64)), pa.array(codes[code].view(np.int64)), pa.array(distance, pa.int32())]
        return pa.Table.from_arrays(columns, names=["q", "code", "distance"])

    met = pairs.groupBy("block", "shard").applyInArrow(run, "q long, code long, distance int")  # groups of one row
    # k nearest codes hold the k nearest ids, and codes as near as the k-th stay for their ids
    nearest = met.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy("distance"))).where(F.col("place") <= k).drop("place")
    rows = nearest.join(held, "code").select("q", "distance", F.explode("ids").alias("id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return asked.join(ranked, asked["code"] == ranked["q"]).select("query_id", "rank", "id", "distance")
