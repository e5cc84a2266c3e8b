"""Importance resampling of documents towards the word statistics of a target.

A task joins the texts of a batch with a separator sentinel, so one regex pass finds the
words of all of them. The sentinels give the word offsets of the documents, and a sorted
search in these tells which runs of words lie in one document; the others are masked
before their hash buckets are counted. Buckets are counted over the whole corpus and the
whole target; a bucket's gain is the log ratio of its two smoothed shares, a document
weighs the sum of its gains, and Gumbel noise on the weights turns the highest scores
into a draw without replacement.

Only the counts of the buckets, whose number is a parameter, pass through the driver.
Ranks come from range partitions and the rows before each, so no task orders all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import portions, settle, texts

SENTINEL = b"\0"
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\0")  # a word in lower case, or the end of a document
MEMO_FEATURES = 200_000  # distinct features whose bucket a task remembers
HIDE = bytes.maketrans(SENTINEL, b" ")


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MEMO_FEATURES:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(batch: list[bytes], longest: int, memo: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every run of 1 to ``longest`` words, and the words of each document."""
    joined = b"".join(part for text in batch for part in (text.lower().translate(HIDE), SENTINEL))
    tokens = TOKEN.findall(joined)
    is_end = np.fromiter((t == SENTINEL for t in tokens), bool, len(tokens))
    ends = np.flatnonzero(is_end)
    ends = ends - np.arange(len(ends))  # words before each document's end
    words = [t for t in tokens if t != SENTINEL]
    n_words = np.diff(ends, prepend=0)
    document = np.searchsorted(ends, np.arange(len(words)), side="right")
    owners, found = [], []
    for size in range(1, longest + 1):
        first = document[: len(words) - size + 1] if len(words) >= size else document[:0]
        whole = np.flatnonzero(first == document[size - 1 :]) if len(first) else first
        runs = words if size == 1 else [b" ".join(words[i : i + size]) for i in whole.tolist()]
        owners.append(first[whole])
        found.append(np.fromiter(map(memo.__getitem__, runs), np.int64, len(runs)))
    return np.concatenate(owners), np.concatenate(found), n_words


def bucket_counts(table: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of the column ``text``; buckets without any are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in portions(batches):
            counts += np.bincount(features(texts(batch), longest, memo)[1], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used])], names=["bucket", "n"])

    return table.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """What every feature adds to a weight, by bucket."""

    gains: np.ndarray
    longest: int


def fit(corpus: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> Model:
    """Gains floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) of b buckets.

    s of the S features of the corpus and t of the T features of the target fall into the
    bucket. Null and empty texts have no features; without any text all gains are 0.
    """
    counts = np.zeros((2, buckets))
    for row, table in zip(counts, (corpus, target)):
        for bucket, n in bucket_counts(table, longest, buckets).collect():  # at most ``buckets`` rows
            row[bucket] = n
    (s, t), (total_s, total_t) = counts, counts.sum(1)
    ratio = (t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets))
    return Model(np.floor(1000 * np.log(ratio)).astype(np.int64), longest)


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of (doc_id, text).

    Null and empty texts have no features and weigh 0. Repeated rows are weighed each;
    other columns are not read. No rows in, no rows out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets(len(model.gains))
        for batch in portions(batches):
            owners, found, n_words = features(texts(batch), model.longest, memo)
            rows = batch.num_rows
            weight = np.zeros(rows, np.int64)
            np.add.at(weight, owners, model.gains[found])
            columns = [n_words, np.bincount(owners, minlength=rows), weight]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of ``seed:doc_id`` (a null id is no digits)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ordered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A column with the place of every row, from 1, in the order given.

    Rows that tie fully are told apart by where they lie, so no range is all one key.
    """
    apart = F.monotonically_increasing_id()
    ranged = rows.withColumn("apart", apart)
    ranged = ranged.repartitionByRange(*order, "apart").withColumn("part", F.spark_partition_id())
    ranged = settle(ranged, "resampling-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order, "apart"))
    placed = ranged.withColumn("within", within).join(F.broadcast(starts), "part")
    return placed.withColumn(name, F.col("before") + F.col("within")).drop("part", "within", "before", "apart")


def resample(docs: DataFrame, model: Model, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row.

    Of the N rows with ``least_words`` words, floor(percent N / 100) with the highest
    scores are drawn and ranked from 1, ties to the smaller doc_id (null first); the others
    have no rank. Rows alike in all of this are drawn in any order.
    """
    scored = weigh(docs, model).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = settle(scored.withColumn("fit", F.col("n_words") >= least_words), "resampling-scores")
    drawn = percent * scored.where("fit").count() // 100
    placed = ordered(scored, [F.desc("fit"), F.desc("score"), F.asc("doc_id")], "place")
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
