"""Line chunks of a text corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import file_type
from tidemark.functions.text import SPACES, has_text
from tidemark.vocab import CHUNK_SIZE

PORTION_BYTES = 2**22  # bytes of texts a task holds in Python form at a time


def _cut(content: str, size: int) -> list[tuple[int, str]]:
    """Whole lines up to the first that brings the characters to ``size``.

    One binary search per chunk over the running line lengths, so the cost does not
    grow with the square of the text as appending in a SQL fold would.
    """
    lines = content.split("\n")
    filled = np.fromiter(accumulate(map(len, lines)), dtype=np.int64, count=len(lines))
    pieces, first, before, number = [], 0, 0, 0
    while first < len(lines):
        last = min(int(np.searchsorted(filled, before + size)), len(lines) - 1)
        last = max(last, first)
        text = "\n".join(lines[first : last + 1]).strip(SPACES)
        if text:
            pieces.append((number, text))
        first, before, number = last + 1, int(filled[last]), number + 1
    return pieces


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PORTION_BYTES`` of contents, or one row where it is longer."""
    ends, start, done = np.cumsum(pc.binary_length(batch.column("content")).to_numpy(zero_copy_only=False) + 64), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + PORTION_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def _cutter(size: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are in Python form a portion at a time, and its chunks go out before the next."""
        for batch in batches:
            for part in _portions(batch):
                pieces = [_cut(content, size) for content in part.column("content").to_pylist()]
                row = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("file").take(pa.array(row)),
                        pa.array([n for p in pieces for n, _ in p], pa.int32()),
                        pa.array([text for p in pieces for _, text in p], pa.string()),
                    ],
                    names=["file", "chunk", "text"],
                )
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return cut


def chunk_id(file: Column, chunk: Column) -> Column:
    return F.md5(F.concat_ws(":", file, chunk.cast("string")))


def nonblank_files(files: DataFrame) -> DataFrame:
    return files.where(has_text(F.col("content")))


def line_chunks(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(path, content) to (id, file, chunk, type, text); blank chunks keep their number."""
    return (
        nonblank_files(files)
        .select(F.col("path").alias("file"), "content")
        .mapInArrow(_cutter(size), "file string, chunk int, text string")
        .select(
            chunk_id(F.col("file"), F.col("chunk")).alias("id"),
            "file",
            "chunk",
            file_type(F.col("file")).alias("type"),
            "text",
        )
    )
