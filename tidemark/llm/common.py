"""What several operators share: Arrow batches in small slices, words, row identity."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

MEMO_WORDS = 1_000_000  # distinct words whose ids a task remembers at a time
SLICE_ROWS = 256  # rows a task holds in Python form at a time
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22
PORTION_BYTES = 1 << 22  # bytes of strings a task holds in Python form at a time


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that long texts are in Python form a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def portions(batches: Iterable[pa.RecordBatch], size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``size`` bytes, or one row where it is longer."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, done = np.cumsum(ends + 64), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    column = batch.column(name)
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), A to Z in lower case."""
    return text.lower().split()


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into one fold; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def in_fold(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are small, whatever the length of the texts."""
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder, read them back, and let go of the shuffles behind them.

    Spark deletes shuffle files once the driver has collected the plan that made
    them; asking for that keeps a job of many steps at the disk of its largest. Batches
    that go to Python are kept small meanwhile, whatever the length of the texts.
    """
    spark = df.sparkSession
    before = spark.conf.get(BATCH_LIMIT)
    small_batches(spark)
    try:
        written = materialise(df, label)
    finally:
        spark.conf.set(BATCH_LIMIT, before)
    spark._jvm.System.gc()
    return written


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run``, with what a task held given back to the system at its end.

    Spark keeps Python workers for later tasks, and the C library keeps what they freed;
    over the stages of a pipeline that adds up beside the heap of the executor.
    """

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Of rows ordered by the keys, the columns of the rows of each key, keys first."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *columns)]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        change = np.zeros(len(now[0]) - 1, bool)
        for c in now[: len(keys)]:
            change |= c[1:] != c[:-1]
        start = 0
        for end in (np.flatnonzero(change) + 1).tolist():
            yield [c[start:end] for c in now]
            start = end
        held = [c[start:] for c in now]
    if held is not None:
        yield held


class _Codes(dict):
    """Numbers words as they are met and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self.new.append(word)
        self[word] = code = len(self)
        return code


class MemoIds:
    """Ids of many words, those of each distinct word (``ids_of``) made once."""

    most = MEMO_WORDS

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.used = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), 0

    def ids_of(self, word) -> list[int]:
        raise NotImplementedError

    def _made(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, one word after the other, and how many each word has."""
        ids = [self.ids_of(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, words: list) -> None:
        flat, sizes = self._made(words)
        known, end = len(self.codes) - len(words), self.used + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.codes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.ids[self.used : end] = flat
        self.sizes[known : known + len(words)] = sizes
        self.starts[known : known + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used = end

    def gather(self, words: list) -> np.ndarray:
        """The ids of all words, one word after the other."""
        return self.gather_sized(words)[0]

    def gather_sized(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each word has."""
        if len(self.codes) > self.most:
            self._clear()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn(self.codes.new)
            self.codes.new = []
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[codes] - ends + sizes, sizes)], sizes
