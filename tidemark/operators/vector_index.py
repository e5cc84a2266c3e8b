"""A stored index of vectors: lists around trained pivots, with radii and residual codes.

Pivots grow with the root of the store. They start from rows spread by the MD5 hash of
their ids and move to the mean direction of what is nearest to them in a sample; every
row of the store is listed under its nearest pivot. A list is written in packed rows of
bounded size, so a list that a third of the store falls into is spread out. Zero vectors
have no direction and make up a list of their own.

Exact search: a query goes to its nearest list, and the k-th score there prunes: a list
whose pivot and radius show that none of its rows scores as high is skipped. Approximate
search: a query goes to its nearest lists, ranks their rows by one-byte residual codes,
and only the best of these are ranked by their vectors. Queries are rows all the way, and
both searches take a fixed number of jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import SCORE_DIGITS, _best, _closest, _ranked, unit_rows
from tidemark.session import materialise
from tidemark.sources import stores
from tidemark.vocab import TOP_K

MOST_PIVOTS = 16_384  # the pivots go to every task; beyond, lists get longer and have more packed rows
SAMPLE_ROWS = 256  # rows per pivot that pivots are trained on
ROUNDS = 1  # moves of the pivots
PACK_ROWS = 1_024  # vectors or queries in a packed row
CODE_STEPS = 127  # steps of a residual code per unit
RERANKED = 8  # rows ranked by their vectors per hit asked for
PROBES = 8  # lists an approximate search looks into
SLACK = 1e-6  # what rounding may add to a bound
ZERO = -1  # the list of zero vectors


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest pivot, the first of equal ones, and the cosine; zero rows have none."""
    scores = np.round(rows @ pivots.T, SCORE_DIGITS) if len(pivots) else np.zeros((len(rows), 1))
    part, some = scores.argmax(1), rows.any(axis=1)
    return np.where(some, part, ZERO), np.where(some, scores[np.arange(len(rows)), part], 1.0)


def _frames(batches: Iterable[pa.RecordBatch], rows: int = 4_096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, unit_rows(part.column("embedding"))


def train(store: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots for (id, embedding), each of length one.

    The sample is bounded by the number of pivots; rows enter it by the hash of their id.
    """
    rows = store.where("embedding is not null").select(F.md5(F.col("id").cast("string")).alias("h"), "embedding")
    total = rows.count()
    wanted = min(MOST_PIVOTS, math.isqrt(max(0, total - 1)) + 1)
    first = rows.orderBy("h").limit(wanted).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    start = np.round(unit_rows(first.column("embedding").combine_chunks()), 6)
    pivots = np.unique(start[start.any(axis=1)], axis=0)
    share = min(1.0, SAMPLE_ROWS * wanted / total)
    sample = rows.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") < share * 2**32).select("embedding")
    for _ in range(rounds if len(pivots) else 0):

        def sums(batches: Iterable[pa.RecordBatch], pivots: np.ndarray = pivots) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(pivots)
            for _, unit in _frames(batches):
                part, _ = _nearest(unit, pivots)
                np.add.at(total, part[part != ZERO], unit[part != ZERO])
            used = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["part", "total"])

        found = sample.mapInArrow(sums, "part int, total array<double>").select("part", F.posexplode("total").alias("i", "x"))
        moved = pivots.copy()
        for part, i, x in found.groupBy("part", "i").agg(F.sum("x")).collect():  # the pivots' components
            moved[part, i] = x
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        pivots = np.round(np.divide(moved, length, out=pivots.copy(), where=length > 0), 6)
    return pivots


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``; any session that reaches the path can search it."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(store: DataFrame, path: str, rounds: int = ROUNDS) -> VectorIndex:
        """Index every row of (id, embedding) that has a vector. A table without rows has an index, too."""
        spark, kind = store.sparkSession, store.schema["id"].dataType.simpleString()
        pivots = train(store, rounds)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, unit in _frames(batches):
                part, cosine = _nearest(unit, pivots)
                rest = unit - np.where(part[:, None] == ZERO, 0, pivots[part]) if len(pivots) else unit
                codes = np.clip(np.floor(rest * CODE_STEPS + 0.5), -CODE_STEPS, CODE_STEPS).astype(np.int8)
                columns = [batch.column("id"), batch.column("embedding"), pa.array(part, pa.int32()), pa.array(cosine), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "part", "cosine", "code"])

        fields = f"id {kind}, embedding array<float>, part int, cosine double, code binary"
        rows = store.where("embedding is not null").select("id", F.col("embedding").cast("array<float>"))
        stores.full_refresh(rows.mapInArrow(assign, fields), f"{path}/rows")
        index = VectorIndex(spark, path)
        listed = stores.read_table(spark, f"{path}/rows", fields)
        # an Arrow table needs no setting of the session, unlike numpy values inside pandas
        table = pa.table([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(list(pivots), pa.list_(pa.float64()))], names=["part", "pivot"])
        known = spark.createDataFrame(table, "part int, pivot array<double>")
        sizes = listed.groupBy("part").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
        stores.full_refresh(sizes.join(known, "part", "left"), f"{path}/lists")
        counts = index.lists.select("part", F.ceil(F.col("n") / PACK_ROWS).cast("int").alias("packs"))
        packed = (
            listed.join(F.broadcast(counts), "part")  # one row a pivot
            .groupBy("part", F.pmod(F.xxhash64("id"), F.col("packs")).alias("pack"))
            .agg(F.collect_list(F.struct("id", "embedding", "code")).alias("held"))
            .select("part", F.col("held.id").alias("ids"), F.col("held.embedding").alias("vectors"), F.col("held.code").alias("codes"))
        )
        stores.full_refresh(packed.repartitionByRange("part"), f"{path}/packs")
        return index

    @property
    def lists(self) -> DataFrame:
        return stores.read_table(self.spark, f"{self.path}/lists", "part int, n long, least double, pivot array<double>")

    def packs(self, *columns: str) -> DataFrame:
        kind = self.rows.schema["id"].dataType.simpleString()
        fields = f"part int, ids array<{kind}>, vectors array<array<float>>, codes array<binary>"
        return stores.read_table(self.spark, f"{self.path}/packs", fields).select("part", *columns)

    @property
    def rows(self) -> DataFrame:
        """Every row of the store with its list; the schema is the files' own, as ids may have any type."""
        newest = stores.newest_version(self.spark, f"{self.path}/rows")
        return self.spark.read.parquet(newest)

    def _pivots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, pivots and least cosines of all lists; the list of zero vectors last, without a pivot."""
        held = self.lists.orderBy(F.col("part") == ZERO, "part").toArrow()  # MOST_PIVOTS rows
        real = held.filter(pa.compute.not_equal(held.column("part"), ZERO)).column("pivot").combine_chunks()
        pivots = real.flatten().to_numpy().reshape(len(real), -1) if len(real) else np.zeros((0, 0))
        return held.column("part").to_numpy(), pivots, held.column("least").to_numpy()

    def bounds(self, queries: DataFrame, nearest: int | None = None) -> DataFrame:
        """(query_id, embedding, part, bound): lists, best first, and what a row of one can score at most.

        With ``nearest`` only so many lists per query.
        """
        parts, pivots, least = self._pivots()
        kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding")]
        schema = f"query_id {kinds[0]}, embedding {kinds[1]}, part int, bound double, place int"
        queries = queries.where("embedding is not null").select("query_id", "embedding")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, unit in _frames(batches, max(1, 2**20 // max(1, len(parts)))):
                scores = np.zeros((len(unit), len(parts)))
                scores[:, : len(pivots)] = unit @ pivots.T if len(pivots) else 0
                angle = np.arccos(np.clip(scores, -1, 1)) - np.arccos(np.clip(least, -1, 1))
                bound = np.cos(np.clip(angle - SLACK, 0, np.pi))
                flat = ~unit.any(axis=1)[:, None] | (parts == ZERO)[None, :]  # without a direction every score is 0
                bound[np.broadcast_to(flat, bound.shape)] = 0.0
                order = np.argsort(-np.round(scores, SCORE_DIGITS), axis=1, kind="stable")[:, :nearest]
                row = np.repeat(np.arange(len(unit)), order.shape[1])
                took = batch.take(pa.array(row))
                place = np.tile(np.arange(order.shape[1], dtype=np.int32), len(unit))
                yield pa.RecordBatch.from_arrays(
                    [*took.columns, pa.array(parts[order].ravel(), pa.int32()), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array(place)],
                    names=["query_id", "embedding", "part", "bound", "place"],
                )

        return queries.mapInArrow(run, schema)

    def _searched(self, wanted: DataFrame, k: int, coded: bool = False) -> DataFrame:
        """(query_id, id, score): per query and packed row of its lists the k best, by vectors or by codes."""
        counts = wanted.groupBy("part").agg(F.ceil(F.count("*") / PACK_ROWS).cast("int").alias("packs"))
        asked = (
            wanted.join(counts, "part").groupBy("part", F.pmod(F.xxhash64("query_id"), F.col("packs")).alias("pack"))
            .agg(F.collect_list(F.struct("query_id", "embedding")).alias("held"))
            .select("part", F.col("held.query_id").alias("keys"), F.col("held.embedding").alias("wanted"))
        )
        column = "codes" if coded else "vectors"
        pairs = asked.join(self.packs("ids", column), "part")
        if coded:
            pairs = pairs.join(self.lists.select("part", "pivot"), "part", "left")
        schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, score double"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    cell = lambda name: batch.column(name)[i]  # noqa: B023, E731
                    queries, ids = unit_rows(cell("wanted")), cell("ids").values.to_numpy(zero_copy_only=False)
                    if coded:
                        codes = np.array([np.frombuffer(c, np.int8) for c in cell("codes").as_py()]) / CODE_STEPS
                        rows = codes + (np.array(cell("pivot").as_py()) if cell("pivot").is_valid else 0)
                    else:
                        rows = unit_rows(cell("vectors"))
                    found = _best(_closest(queries, ids, rows, k), k)
                    keys = cell("keys").values.take(pa.array(found["query"].to_numpy()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(found["id"]), pa.array(found["score"])], names=["query_id", "id", "score"])

        return pairs.mapInArrow(run, schema)

    def plan(self, queries: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
        """The hits of every query's nearest list, and the other lists that it cannot skip.

        A list is skipped if its bound is below the k-th score met so far; with fewer than
        k hits none is. Both tables are written.
        """
        every = materialise(self.bounds(queries), "index-bounds")
        near = materialise(self._searched(every.where("place = 0"), k), "index-near")
        kth = _ranked(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        open_ = every.where("place > 0").join(kth, "query_id", "left")
        return near, materialise(open_.where("kth is null or round(bound, 9) >= kth - 1e-9").drop("kth"), "index-open")

    def exact_top_k(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """(query_id, rank, id, score) by exact cosine, as a scan of the whole store would give."""
        near, rest = self.plan(queries, k)
        return _ranked(near.unionByName(self._searched(rest, k)), k)

    def probes_for(self, recall: float, k: int = TOP_K, sample: int = 64) -> int:
        """How many lists hold the given share of the true neighbours of some rows of the store.

        ``sample`` rows, the first by the hash of their id, are searched exactly.
        """
        h = F.md5(F.col("id").cast("string"))
        asked = self.rows.orderBy(h).limit(sample).select(F.col("id").alias("query_id"), "embedding")
        asked = materialise(asked, "index-sample")
        hits = self.exact_top_k(asked, k + 1).where("query_id <> id").select("query_id", "id").join(self.rows.select("id", "part"), "id")
        places = hits.join(self.bounds(asked).select("query_id", "part", "place"), ["query_id", "part"])
        found = places.agg(F.percentile("place", F.lit(recall)).alias("p")).first()["p"]  # sample * k places
        return 1 if found is None else math.ceil(found) + 1

    def approximate_top_k(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES) -> DataFrame:
        """Cosine ranking of the rows whose codes rank best in the ``probes`` nearest lists."""
        asked = materialise(self.bounds(queries, probes), "index-probes")
        coded = _ranked(self._searched(asked, RERANKED * k, coded=True), RERANKED * k).select("query_id", "id")
        vectors = asked.where("place = 0").select("query_id", F.col("embedding").alias("wanted"))
        met = coded.join(self.rows.select("id", "embedding"), "id").join(vectors, "query_id")
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, score double"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = (unit_rows(batch.column("wanted")) * unit_rows(batch.column("embedding"))).sum(1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("id"), pa.array(np.round(scores, SCORE_DIGITS) + 0.0)], names=["query_id", "id", "score"]
                )

        return _ranked(met.select("query_id", "id", "wanted", "embedding").mapInArrow(run, schema), k)
