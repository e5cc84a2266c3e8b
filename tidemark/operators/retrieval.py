"""Vectors of text, nearest neighbours and prompts built from them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.md5 import md5_heads
from tidemark.session import materialise
from tidemark.vocab import CONTEXT_HITS, HISTORY_TURNS, TOP_K

WORD = r"[\p{L}\p{N}_]+"
SCORE_DIGITS = 9  # scores are ranked at this precision, ties by id
QUERY_BLOCK = 4_096  # query rows per block
SIGNATURE_BITS = 8
FLIPS = 2  # bits of a signature that probing changes at most
MATRIX_CELLS = 2**22  # numbers in one matrix inside a task
WORDS = 2**18  # words hashed at a time
PACK_CELLS = 2**17  # numbers in one packed row of a store
PACK_ROWS = 1_024  # rows of a store that queries meet at a time
FEW = 2**12  # queries that a task holds beside the packed store
GROUP_QUERIES = 2**17  # queries of a cell of the grid
GRID_TASKS = 4  # cells of the grid per core
PACKING_BYTES = 2**25  # vectors that a task holds while it packs them
TOP_QUERIES = 2**10  # queries that meet some rows in one matrix
BOUND_DIM, BOUND_QUERIES = 32, 2**8  # components and queries from which on bounds pay
BOUND_LEFT = 2.0**-8  # share of a matrix that bounds may leave over
WAITING_ROWS = 2**16  # hits gathered before they are merged with those held


# -- vectors ---------------------------------------------------------------------


def word_slots(text: Column, dim: int) -> Column:
    """Slot of every word: its MD5 hash modulo the vector length."""

    def slots_of(words: pa.Array) -> np.ndarray:
        """Each distinct word is hashed once."""
        coded = words.dictionary_encode()
        held = coded.dictionary.cast(pa.string())
        ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        slots = md5_heads(np.frombuffer(held.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)) % dim
        return slots.astype(np.int32)[coded.indices.to_numpy()]

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes, words = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
            slots = [slots_of(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, np.int32), *slots])), mask=lists.is_null() if lists.null_count else None)

    return find(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0))


def _slots(texts: DataFrame, dim: int) -> DataFrame:
    """Texts with the slots of their words, where they have none yet."""
    return texts if "slots" in texts.columns else texts.withColumn("slots", word_slots(F.col("text"), dim))


def _slot_counts(slots: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """How often every slot occurs in each text, for some texts at a time."""
    sizes, flat = pc.list_value_length(slots).fill_null(0).to_numpy(zero_copy_only=False), slots.flatten().to_numpy()
    ends, step = np.cumsum(sizes), max(1, PACK_CELLS // dim)
    for at in range(0, len(slots), step):
        size = sizes[at : at + step]
        stop, row = ends[at + len(size) - 1], np.repeat(np.arange(len(size)), size)
        yield np.bincount(row * dim + flat[stop - len(row) : stop], minlength=len(size) * dim).reshape(len(size), dim)


@dataclass(frozen=True)
class TermWeights:
    """Hashed word counts weighted by how few texts have the word, length one."""

    idf: tuple[float, ...]

    @staticmethod
    def fit(texts: DataFrame, dim: int = 256) -> TermWeights:
        """Count the texts per slot; only ``dim`` numbers of every task come back.

        Texts that have the column ``slots`` are not split again, here and by ``encode``.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(dim + 1, np.int64)  # the last counts all texts
            for batch in batches:
                slots = batch.column("slots")
                for counts in _slot_counts(slots, dim):
                    seen[:dim] += (counts > 0).sum(0)
                seen[dim] += len(slots) - slots.null_count
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(seen)], names=["slot", "texts"])

        seen = np.zeros(dim + 1)
        found = _slots(texts.select(*(c for c in texts.columns if c in ("text", "slots"))), dim).select("slots").mapInArrow(count, "slot long, texts long")
        for slot, number in found.groupBy("slot").agg(F.sum("texts")).collect():  # dim + 1 rows
            seen[slot] = number
        total, seen = seen[dim], seen[:dim]
        return TermWeights(tuple(np.log((1 + total) / (1 + seen))))

    def encode(self, texts: DataFrame) -> DataFrame:
        idf, dim = np.array(self.idf), len(self.idf)

        @F.arrow_udf("array<float>")
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for slots in batches:
                found = np.concatenate([np.zeros((0, dim), np.float32), *(_unit(counts * idf).astype(np.float32) for counts in _slot_counts(slots, dim))])
                starts = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * dim)
                yield pa.ListArray.from_arrays(starts, pa.array(found.ravel()), mask=slots.is_null() if slots.null_count else None)

        return _slots(texts, dim).withColumn("embedding", weigh("slots")).select(*texts.columns, "embedding")


def encode_with(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Vectors from any model: ``load`` runs once per task and returns the encoder."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(encode(batch.tolist()), dtype=np.float32)))

    return texts.withColumn("embedding", run("text"))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows, dtype=float), where=length > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack(vectors.to_numpy()).astype(np.float64))


# -- nearest neighbours ------------------------------------------------------------


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query", sort=False).head(k)


def _closest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k rows closest to each query, all ties at the border looked at."""
    parts = []
    step = max(1, MATRIX_CELLS // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        scores = np.round(queries[start : start + step] @ vectors.T, SCORE_DIGITS) + 0.0
        keep = min(k, scores.shape[1])
        border = np.partition(scores, -keep, axis=1)[:, -keep]
        query, row = np.nonzero(scores >= border[:, None])
        found = pd.DataFrame({"query": query + start, "id": ids[row], "score": scores[query, row]})
        parts.append(_best(found, k))
    return pd.concat(parts, ignore_index=True)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _hit_schema(queries: DataFrame, store: DataFrame) -> str:
    return (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"id {store.schema['id'].dataType.simpleString()}, score double"
    )


def dealt(rows: DataFrame, key: str, parts: int, bucket: str) -> DataFrame:
    """Rows (key, embedding) packed by hash into ``parts`` rows: bucket, keys, vectors."""
    return (
        rows.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(bucket))
        .agg(F.collect_list(F.struct(key, "embedding")).alias("held"))  # a block of them
        .select(bucket, F.col(f"held.{key}").alias("keys"), F.col("held.embedding").alias("vectors"))
    )


def unit_rows(vectors: pa.ListScalar | pa.ListArray) -> np.ndarray:
    """A matrix of rows of length one from a list of vectors."""
    nested = vectors.values if isinstance(vectors, pa.ListScalar) else vectors
    return _unit(nested.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(nested), -1))


def _rows_of(vectors: pa.ListScalar | pa.ListArray) -> np.ndarray:
    """A matrix of vectors as they are."""
    nested = vectors.values if isinstance(vectors, pa.ListScalar) else vectors
    return nested.flatten().to_numpy(zero_copy_only=False).reshape(len(nested), -1)


def _places(hits: np.ndarray) -> np.ndarray:
    """Where a matrix of truths is true, row by row; few are, so 64 are looked at together first."""
    flat = hits.ravel()
    if len(flat) % 64:
        return np.flatnonzero(flat)
    eights = flat.view(np.uint64) != 0
    some = np.flatnonzero(eights.view(np.uint64) != 0)
    for level in (eights, flat):
        place, within = np.nonzero(level.reshape(-1, 8)[some])
        some = some[place] * 8 + within
    return some


class _Bounds:
    """Pairs of components, and numbers whose products bound the products of whole vectors.

    Components i and j of a pair give one number per vector: (|qi|^1.5 + |qj|^1.5)^(2/3) for a
    query and (|ri|^3 + |rj|^3)^(1/3) for a row. By Hoelder's inequality their product is never
    below qi ri + qj rj, whatever the vectors. The components of least weight are paired, light
    ones with heavier ones; all others stay as they are.
    """

    def __init__(self, weight: np.ndarray, pairs: int):
        order = np.argsort(weight, kind="stable")
        self.one, self.other, self.alone = order[:pairs], order[pairs : 2 * pairs][::-1], order[2 * pairs :]

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        one, other = np.abs(rows[:, self.one]), np.abs(rows[:, self.other])
        return np.concatenate([rows[:, self.alone], np.cbrt(one * np.sqrt(one) + other * np.sqrt(other)) ** 2], axis=1).astype(np.float32)

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        one, other = np.abs(rows[:, self.one]), np.abs(rows[:, self.other])
        return np.concatenate([rows[:, self.alone], np.cbrt(one**3 + other**3)], axis=1).astype(np.float32)


class _Top:
    """The k best rows for each of some queries, among all rows that come by.

    Bounds of the products are taken over fewer numbers than a vector has (``_Bounds``) where
    few of them reach the k-th best score met so far; what reaches it is taken again in single
    precision, and what still does in double precision. How coarse the bounds are is chosen for
    each block of queries by what they left over before: it decides on the time only. Queries
    that have met fewer than k rows look at those that reach the k-th score of their own
    matrix. All ties at the border are looked at. What is held is k rows per query and ties.
    """

    def __init__(self, keys: pa.Array, vectors: np.ndarray, k: int):
        self.keys, self.vectors, self.k = keys, vectors, k
        parts = range(0, len(vectors), QUERY_BLOCK)
        length = np.concatenate([np.linalg.norm(vectors[i : i + QUERY_BLOCK].astype(np.float64), axis=1) for i in parts])
        self.length = length[:, None]
        self.single = np.concatenate([self._double(slice(i, i + QUERY_BLOCK)).astype(np.float32) for i in parts])
        self.slack = 2 * (vectors.shape[1] + 4) * 2.0**-23 + 10.0**-SCORE_DIGITS
        self.best = np.full((len(vectors), k), -np.inf)  # rising
        self.kth = self.best[:, 0]
        self.found, self.waiting, self.limit = [], 0, WAITING_ROWS
        self.bounds: list[tuple[_Bounds, np.ndarray]] | None = None  # with the numbers of the queries, coarse ones first
        blocks = -(-len(vectors) // TOP_QUERIES)
        self.level, self.wait, self.pause = np.full(blocks, -1), np.ones(blocks, int), np.ones(blocks, int)

    def _double(self, query: slice | np.ndarray) -> np.ndarray:
        """Queries of length one in double precision."""
        rows, length = self.vectors[query], self.length[query]
        return np.divide(rows, length, out=np.zeros(rows.shape), where=length > 0, dtype=np.float64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Look at more rows, of length one."""
        step = -(-len(rows) // max(1, round(len(rows) / PACK_ROWS))) or 1
        for at in range(0, len(rows), step):
            self._meet(ids[at : at + step], rows[at : at + step])
        if self.waiting > self.limit:
            self._settle()
            self.limit = max(WAITING_ROWS, 2 * self.waiting)

    def _choose(self, rows: np.ndarray) -> None:
        """Bounds for these queries; none where they would not pay."""
        dim, self.bounds = rows.shape[1], []
        if dim >= BOUND_DIM and len(self.single) >= BOUND_QUERIES:
            weight = np.abs(self.single[:PACK_ROWS]).mean(0) * np.abs(rows).mean(0)
            for pairs in (dim // 2, 3 * dim // 8, dim // 4):
                bound = _Bounds(weight, pairs)
                parts = [bound.of_queries(self.single[i : i + QUERY_BLOCK].astype(np.float64)) for i in range(0, len(self.single), QUERY_BLOCK)]
                self.bounds.append((bound, np.concatenate(parts)))
            self.level[:] = len(self.bounds)

    def _meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.bounds is None:
            self._choose(rows)
        single, coarse = rows.astype(np.float32), {}
        for block, at in enumerate(range(0, len(self.single), TOP_QUERIES)):
            asked, border = self.single[at : at + TOP_QUERIES], self.kth[at : at + TOP_QUERIES].copy()
            new = np.flatnonzero(border == -np.inf)
            whole, query, row = len(new) > 0 or not self.bounds, None, None
            if not whole:
                self.wait[block] -= 1
                if self.wait[block] <= 0 and self.level[block] > 0:
                    self.level[block] -= 1
                    self.wait[block] = 1
                level = self.level[block]
                whole = level == len(self.bounds)
            if not whole:
                bound, numbers = self.bounds[level]
                if level not in coarse:
                    coarse[level] = bound.of_rows(rows).T
                reach = (border - self.slack).astype(np.float32)
                near = _places(numbers[at : at + TOP_QUERIES] @ coarse[level] >= reach[:, None])
                left = len(near) / (len(asked) * len(rows))
                if left > BOUND_LEFT:  # finer ones, for longer each time
                    self.level[block] += 1
                    self.pause[block] = min(2 * self.pause[block], 256)
                    self.wait[block] = self.pause[block]
                elif left > BOUND_LEFT / 8:
                    self.wait[block] = max(self.wait[block], 2)  # coarser ones would leave more
                whole = left > 4 * BOUND_LEFT
                if not whole:
                    query, row = np.divmod(near, len(rows))
                    parts = range(0, len(near), PACK_ROWS)
                    close = [np.einsum("ij,ij->i", asked[query[i : i + PACK_ROWS]], single[row[i : i + PACK_ROWS]]) >= reach[query[i : i + PACK_ROWS]] for i in parts]
                    close = np.concatenate([np.zeros(0, bool), *close])
                    query, row = query[close] + at, row[close]
            if whole:
                scores = asked @ single.T
                if len(new):
                    keep = min(self.k, len(rows))
                    border[new] = np.partition(scores[new], -keep, axis=1)[:, -keep]
                reach = (border - self.slack).astype(np.float32)
                query, row = np.divmod(_places(scores >= reach[:, None]), len(rows))
                query = query + at
            self._take(ids, rows, query, row, at, len(asked))

    def _take(self, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, row: np.ndarray, at: int, size: int) -> None:
        """Products in double precision, and the new k-th scores."""
        if len(query) * 16 > size * len(rows):  # many ties
            exact = (self._double(slice(at, at + size)) @ rows.T)[query - at, row]
        else:
            parts = range(0, len(query), PACK_ROWS)
            exact = np.concatenate([np.zeros(0), *((self._double(query[i : i + PACK_ROWS]) * rows[row[i : i + PACK_ROWS]]).sum(1) for i in parts)])
        exact = np.round(exact, SCORE_DIGITS) + 0.0
        good = np.flatnonzero(exact >= self.kth[query])
        if not len(good):
            return
        query, row, exact = query[good], row[good], exact[good]
        order = np.lexsort((-exact, query))
        query, row, exact = query[order], row[order], exact[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        for turn in range(min(self.k, int(place.max()) + 1)):
            now = np.flatnonzero(place == turn)
            risen = np.concatenate([self.best[query[now]], exact[now, None]], axis=1)
            risen.sort(axis=1)
            self.best[query[now]] = risen[:, 1:]
        still = np.flatnonzero(exact >= self.kth[query])
        self.found.append((query[still], ids[row[still]], exact[still]))
        self.waiting += len(still)

    def _settle(self) -> None:
        """Let go of what no longer is among the k best."""
        query, ids, scores = (np.concatenate(x) for x in zip(*self.found))
        good = scores >= self.kth[query]
        self.found = [(query[good], ids[good], scores[good])]
        if good.sum() > self.best.size:  # ties
            held = _best(pd.DataFrame(dict(zip(("query", "id", "score"), self.found[0]))), self.k)
            self.found = [tuple(held[c].to_numpy() for c in ("query", "id", "score"))]
        self.waiting = len(self.found[0][0])

    def result(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self._settle()
        held = _best(pd.DataFrame(dict(zip(("query", "id", "score"), self.found[0]))), self.k)
        for at in range(0, len(held), WAITING_ROWS):
            part = held.iloc[at : at + WAITING_ROWS]
            columns = [self.keys.take(pa.array(part["query"].to_numpy())), pa.array(part["id"], from_pandas=True), pa.array(part["score"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])


def _kind(rows: DataFrame) -> type:
    """How the numbers of packed vectors are held."""
    return np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64


def _packs(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, keys, vectors): rows dealt by the hash of their key into ``parts``, packed where they lie."""
    kind, name = _kind(rows), dict(rows.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        number, size = Counter(), 0

        def out(part: int) -> pa.RecordBatch:
            keys, vectors = zip(*held.pop(part))
            keys, vectors = pa.concat_arrays(keys), np.concatenate(vectors)
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), lists, pa.array([vectors.tobytes()], pa.binary())], names=["part", "keys", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            dealt = batch.column("part").to_numpy()
            order = np.argsort(dealt, kind="stable")
            vectors, keys, cuts = _rows_of(batch.column("embedding")).astype(kind)[order], batch.column(key).take(pa.array(order)), np.flatnonzero(np.diff(dealt[order])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                for at in range(start, end, PACK_ROWS):
                    part, some = int(dealt[order[at]]), slice(at, min(end, at + PACK_ROWS))
                    held.setdefault(part, []).append((keys[some], vectors[some].copy()))
                    number[part] += some.stop - some.start
                    size += vectors[some].nbytes
                    if number[part] >= PACK_ROWS:
                        size -= sum(v.nbytes for _, v in held[part])
                        number[part] = 0
                        yield out(part)
            if size > PACKING_BYTES:
                yield from map(out, list(held))
                number, size = Counter(), 0
        yield from map(out, list(held))

    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key, "embedding")
    return dealt.mapInArrow(pack, f"part int, keys array<{name}>, vectors binary")


def _unpacked(keys: pa.ListScalar, vectors: pa.BinaryScalar, kind: type) -> tuple[pa.Array, np.ndarray]:
    return keys.values, np.frombuffer(vectors.as_buffer(), kind).reshape(len(keys.values), -1)


def cosine_top_k(queries: DataFrame, store: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine ranking: (query_id, embedding) against (id, embedding).

    Few queries are packed by hash into rows of about ``block`` and the store, where it
    lies, into rows of a few thousand numbers; every packed row of the store meets all
    packed rows of queries by their number. Spark sends the queries to all tasks while
    their written table is small, and joins by sorting beyond that. More than ``FEW``
    queries meet the store in a grid instead. The number of jobs does not grow with the
    number of queries. A store smaller than k gives all its rows.
    """
    queries = queries.where("embedding is not null").select("query_id", "embedding")
    store = store.where("embedding is not null").select("id", "embedding")
    total = queries.count()
    if total > FEW:
        return _ranked(_grid(queries, store, k, total), k)
    schema = _hit_schema(queries, store)
    asked_kind, name, parts = _kind(queries), dict(queries.dtypes)["query_id"], -(-total // block)
    kind = store.schema["id"].dataType.simpleString()

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes: they go to Python again with every pack of the store."""
        for batch in batches:
            vectors = pa.array([_rows_of(v).astype(asked_kind).tobytes() for v in batch.column("vectors")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("keys"), vectors], names=["block", "keys", "vectors"])

    asked = materialise(dealt(queries, "query_id", max(1, parts), "block").mapInArrow(flat, f"block int, keys array<{name}>, vectors binary"), "queries")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = batch.slice(at, max(1, PACK_CELLS // max(1, len(batch.column("embedding")[at]))))
                lists = [pa.ListArray.from_arrays([0, rows.num_rows], rows.column(c)) for c in ("id", "embedding")]
                yield pa.RecordBatch.from_arrays(lists, names=["ids", "rows"])
                at += rows.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Top] = {}  # at most FEW queries
        for batch in batches:
            keys, asked, ids, rows = (batch.column(c) for c in ("keys", "vectors", "ids", "rows"))
            for i, number in enumerate(batch.column("block").to_pylist()):
                if number not in held:
                    held[number] = _Top(*_unpacked(keys[i], asked[i], asked_kind), k)
                held[number].add(ids[i].values.to_numpy(zero_copy_only=False), unit_rows(rows[i]))
        for top in held.values():
            yield from top.result()

    packed = store.mapInArrow(pack, f"ids array<{kind}>, rows array<array<float>>")
    # without queries the last number lies before the first, and a sequence would count down
    numbers = F.sequence(F.lit(0), F.lit(parts - 1)) if parts else F.array().cast("array<int>")
    met = packed.withColumn("block", F.explode(numbers)).join(asked, "block").select("block", "keys", "vectors", "ids", "rows")
    return _ranked(met.mapInArrow(run, schema), k)


def _grid(queries: DataFrame, store: DataFrame, k: int, total: int) -> DataFrame:
    """(query_id, id, score) with the k best rows of every cell of a grid among them.

    Queries are dealt by hash into groups that a task can hold, the store into shares, and
    a cell is a group and a share. Its queries come first, then the rows of its share
    stream by, both packed. A row is shuffled once per group, a query once per share, and a
    cell gives at most k rows per query.
    """
    groups = -(-total // GROUP_QUERIES)
    shares = -(-GRID_TASKS * queries.sparkSession.sparkContext.defaultParallelism // groups)
    kinds, asked_kind, kind = {**dict(queries.dtypes), **dict(store.dtypes)}, _kind(queries), _kind(store)
    asked = _packs(queries, "query_id", groups).select(
        F.col("part").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("stored"),
        F.col("keys").alias("query_ids"), F.lit(None).cast(f"array<{kinds['id']}>").alias("ids"), "vectors",
    )
    rows = _packs(store, "id", shares).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("part").alias("share"), F.lit(True).alias("stored"),
        F.lit(None).cast(f"array<{kinds['query_id']}>").alias("query_ids"), F.col("keys").alias("ids"), "vectors",
    )
    cell = (F.col("group") * shares + F.col("share")).alias("cell")
    dealt_out = (
        asked.unionByName(rows).select(cell, "stored", "query_ids", "ids", "vectors")
        .repartitionById(groups * shares, "cell").sortWithinPartitions("cell", "stored")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, top, rows, waiting = None, [], None, [], 0

        def meet() -> None:
            if rows:
                ids, vectors = zip(*rows)
                top.add(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ids]), _unit(np.concatenate(vectors).astype(np.float64)))

        for batch in batches:
            for i, (cell, stored) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("stored").to_pylist())):
                if cell != now:
                    if top is not None:
                        meet()
                        yield from top.result()
                    now, asked, top, rows, waiting = cell, [], None, [], 0
                if not stored:
                    asked.append(_unpacked(batch.column("query_ids")[i], batch.column("vectors")[i], asked_kind))
                    continue
                if top is None and asked:
                    keys, vectors = zip(*asked)
                    top, asked = _Top(pa.concat_arrays(keys), np.concatenate(vectors), k), []
                if top is None:
                    continue  # no query in this group
                rows.append(_unpacked(batch.column("ids")[i], batch.column("vectors")[i], kind))
                waiting += len(rows[-1][0])
                if waiting >= PACK_ROWS:  # small packs are met together
                    meet()
                    rows, waiting = [], 0
        if top is not None:
            meet()
            yield from top.result()

    return dealt_out.mapInArrow(run, _hit_schema(queries, store))


def signature(vector: Column, bits: int = SIGNATURE_BITS) -> Column:
    """On which side of ``bits`` fixed hyperplanes a vector lies, as one number.

    Plane j adds component i with the sign of the parity of i AND (2 j + 1). Components
    count in millionths, as whole numbers, so the side does not hang on the order of a sum.
    """

    def side(j: int) -> Column:
        def signed(x: Column, i: Column) -> Column:
            odd = F.bit_count(i.bitwiseAND(F.lit(2 * j + 1))) % 2
            return F.round(x.cast("double") * 1_000_000).cast("long") * (1 - 2 * odd)

        total = F.aggregate(F.transform(vector, signed), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(total > 0, 1 << j).otherwise(0)

    return reduce(lambda a, b: a + b, map(side, range(bits)))


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, F.round(dot(a, b) / length, SCORE_DIGITS) + 0.0).otherwise(0.0)


def approximate_top_k(
    queries: DataFrame, store: DataFrame, k: int = TOP_K, bits: int = SIGNATURE_BITS, flips: int = FLIPS
) -> DataFrame:
    """Cosine ranking among the rows whose signature differs in at most ``flips`` bits.

    Both sides meet by equality of signatures, a query under each changed form, and what
    meets is ranked exactly. A larger store wants more bits: each one halves the rows
    per signature. A signature that many rows share is split by adaptive skew handling.
    """
    masks = [m for m in range(1 << bits) if m.bit_count() <= flips]
    probes = queries.select(
        "query_id", F.col("embedding").alias("wanted"), signature(F.col("embedding"), bits).alias("own")
    ).select("query_id", "wanted", F.explode(F.transform(F.lit(masks), lambda m: m.bitwiseXOR(F.col("own")))).alias("side"))
    rows = store.select("id", "embedding", signature(F.col("embedding"), bits).alias("side"))
    met = probes.join(rows, "side").select("query_id", "id", _cosine(F.col("wanted"), F.col("embedding")).alias("score"))
    return _ranked(met, k)


# -- prompts ---------------------------------------------------------------------------

# The texts around the parts of a prompt.
CONTEXT_HEAD = "RELEVANT CODEBASE CONTEXT:\n"
HISTORY_HEAD = "CONVERSATION HISTORY:"
CONTEXT_RULE = "\n---\n"


def contexts(hits: DataFrame, chunks: DataFrame, limit: int = CONTEXT_HITS) -> DataFrame:
    """The best ``limit`` chunks of each query as one text."""
    piece = F.concat(F.lit("["), F.coalesce("file", F.lit("?")), F.lit("]\n"), "text")
    joined = chunks.select("id", "file", "text").join(hits.where(F.col("rank") <= limit), "id")
    pieces = F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece"))))  # limit entries
    return joined.groupBy("query_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), CONTEXT_RULE).alias("context")
    )


def history_tails(turns: DataFrame, keep: int = HISTORY_TURNS) -> DataFrame:
    """The last ``keep`` turns of each conversation as one text.

    The rank filter runs before the shuffle, so a long conversation sends only its
    last turns of each partition.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= keep)
    line = F.concat(F.lit("\n"), F.upper("role"), F.lit(": "), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))  # keep entries
    return last.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "").alias("history")
    )


def questions(conversations: DataFrame) -> DataFrame:
    """The last user turn of each conversation."""
    return (
        conversations.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("asked"), F.max_by("text", "turn").alias("message"))
    )


def question_vectors(conversations: DataFrame, weights: TermWeights) -> DataFrame:
    """(query_id, embedding) of the last user turn of each conversation, written once.

    Questions are dealt out by number of tasks: few bytes of text take long to split.
    """
    asked = questions(conversations).select(F.col("conv_id").alias("query_id"), F.col("message").alias("text"))
    tasks = conversations.sparkSession.sparkContext.defaultParallelism
    return materialise(weights.encode(asked.repartition(tasks, "query_id")).select("query_id", "embedding"), "questions")


def prompts(conversations: DataFrame, context: DataFrame) -> DataFrame:
    """One prompt per conversation: context, earlier turns, the question."""
    asked = questions(conversations)
    earlier = conversations.join(asked.select("conv_id", "asked"), "conv_id").where(F.col("turn") < F.col("asked"))
    tails = history_tails(earlier.drop("asked"))

    def section(head: str, body: str) -> Column:
        return F.when(F.col(body).isNull(), "").otherwise(F.concat(F.lit(head), F.col(body), F.lit("\n\n")))

    return (
        asked.join(tails, "conv_id", "left")
        .join(context.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
        .select(
            "conv_id",
            F.concat(
                section(CONTEXT_HEAD, "context"),
                section(HISTORY_HEAD, "history"),
                F.lit("USER: "), "message", F.lit("\n\nA:"),
            ).alias("prompt"),
        )
    )


def sources(hits: DataFrame, chunks: DataFrame, limit: int = TOP_K) -> DataFrame:
    """File and type of every hit."""
    wanted = hits.where(F.col("rank") <= limit)
    # Only the chunks that were hit go on to the outer join.
    found = chunks.select("id", "file", "type").join(wanted.select("id").distinct(), "id", "left_semi")
    return (
        wanted.join(found, "id", "left")
        .select("query_id", "rank", F.coalesce("file", F.lit("?")).alias("file"), F.coalesce("type", F.lit("?")).alias("type"))
    )
