"""A tree of code files, listed and read in tasks.

Spark's own file sources leave out names that start with ``_`` or ``.``, which would
lose files such as ``__init__.py``; this source reads them. Folders are rows: each round
lists one level of them in tasks and writes what it finds, and only the number and size
of the files come back. Files are then dealt by hash into tasks of similar size.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Rounds
from tidemark.sources.stores import filesystem
from tidemark.vocab import CODE_EXTENSIONS, SKIPPED_FOLDERS

TASK_BYTES = 32 * 2**20
OPEN_BYTES = 2**16  # what opening one more file is worth
LISTED_FOLDERS = 64  # folders that a task lists
FOUND_ROWS = 10_000  # rows a task holds
READ_ROWS, READ_CHARS = 1_000, 2**22  # files, or characters of them, that a task holds
ENTRY = "path string, size long, folder boolean"


def qualified(spark: SparkSession, path: str) -> str:
    """The location as Spark resolves it: one without a scheme is on its default file system."""
    place, system = filesystem(spark, path)
    return system.makeQualified(place).toString().rstrip("/")


def _filesystem(uri: str):
    from pyarrow import fs

    # the short form of a local address has no host part
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _list(uri: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = _filesystem(uri)
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "size", "folder"]
        )
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for entry in system.get_file_info(fs.FileSelector(folder)):
                    is_folder = entry.type == fs.FileType.Directory
                    wanted = entry.base_name not in SKIPPED_FOLDERS if is_folder else os.path.splitext(entry.base_name)[1].lower() in CODE_EXTENSIONS
                    if wanted:
                        rows.append((entry.path, entry.size or 0, is_folder))
                    if len(rows) >= FOUND_ROWS:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()

    return run


def list_code_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all eligible files below ``path``, as a written table."""
    uri = qualified(spark, path)
    _, root = _filesystem(uri)
    found = Rounds(spark, "code-tree-levels", ENTRY)
    level, folders = spark.createDataFrame([(root, 0, True)], ENTRY), 1
    while folders:
        tasks = -(-folders // LISTED_FOLDERS)
        level = found.add(level.repartition(tasks, "path").mapInArrow(_list(uri), ENTRY)).where("folder")
        folders = level.count()
    return found.all().where("not folder").select("path", "size")


def _read(uri: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(uri)
        start = len(root.rstrip("/")) + 1
        names, contents, held = [], [], 0
        flush = lambda: pa.RecordBatch.from_pydict({"file_ord": names, "path": names, "content": contents})
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path) as stream:
                    content = stream.read().decode("utf-8", errors="ignore")
                # Text mode reads any line ending as a newline.
                content = content.replace("\r\n", "\n").replace("\r", "\n")
                if content and not content.isspace():
                    names.append(path[start:])
                    contents.append(content)
                    held += len(content)
                if held >= READ_CHARS or len(names) >= READ_ROWS:
                    yield flush()
                    names, contents, held = [], [], 0
        if names:
            yield flush()

    return run


def read_code_tree(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank eligible files below ``path`` with their relative paths.

    ``file_ord`` is the relative path itself: an order no listing can change.
    """
    files = list_code_tree(spark, path)
    total = files.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0))).first()[0]
    dealt = files.select("path").repartition(max(1, -(-total // TASK_BYTES)), "path")
    return dealt.mapInArrow(_read(qualified(spark, path)), "file_ord string, path string, content string")


def write_code_tree(files: DataFrame, path: str) -> None:
    """Write (path, content) rows as files below ``path``."""

    uri = qualified(files.sparkSession, path)

    def write(batches):
        import pandas as pd

        system, root = _filesystem(uri)
        made: set[str] = set()
        for batch in batches:
            for relative, content in zip(batch["path"], batch["content"]):
                target = f"{root}/{relative}"
                if (folder := os.path.dirname(target)) not in made:
                    if len(made) >= FOUND_ROWS:
                        made.clear()
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as stream:
                    stream.write(content.encode())
            yield pd.DataFrame({"written": [len(batch)]})

    files.select("path", "content").mapInPandas(write, "written long").agg({"written": "sum"}).collect()
