"""Workflow definitions (DAGs) mined from Python files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import extension
from tidemark.functions.text import has_text
from tidemark.vocab import TASK_CLASSES

# Patterns that mark workflow files and, where a file cannot be parsed,
# find the pieces of a definition.
WORKFLOW_FILE = r"(?iU)(from\s+airflow|import\s+airflow|DAG\s*\(|@dag\b|airflow\.DAG)"
ID_PATTERNS = (
    r"(?U)DAG\s*\(\s*['\"]([^'\"]+)['\"]",
    r"(?U)dag_id\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?Us)@dag\b.*?def\s+(\w+)\s*\(",
)
SCHEDULE_PATTERNS = (
    r"(?U)schedule_interval\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?U)schedule\s*=\s*['\"]([^'\"]+)['\"]",
)
TASK_ID = r"(?U)task_id\s*=\s*['\"]([^'\"]+)['\"]"
OWNER = r"(?U)['\"]owner['\"]\s*:\s*['\"]([^'\"]+)['\"]"
TAG_LIST = r"(?U)tags\s*=\s*\[([^\]]+)\]"
TAG = r"['\"]([^'\"]+)['\"]"

PARSED = (
    "dag_id string, schedule string, tasks array<string>, owners array<string>, "
    "tags array<string>, description string, catchup boolean, max_active_runs long"
)
FIELDS = [part.split()[0] for part in PARSED.split(", ")]
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def is_workflow_file(content: Column) -> Column:
    return content.rlike(WORKFLOW_FILE)


def _name(node: ast.AST | None) -> str:
    """``f`` of ``f`` and ``x.f``."""
    return getattr(node, "id", getattr(node, "attr", ""))


def _constant(node: ast.AST | None, kind: type):
    value = getattr(node, "value", None) if isinstance(node, ast.Constant) else None
    return value if isinstance(value, kind) else None


def _preorder(node: ast.AST, closed: tuple = ()) -> Iterator[ast.AST]:
    """All nodes, parents first, in reading order; ``closed`` kinds are not entered."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, closed):
            stack.extend(reversed(list(ast.iter_child_nodes(node))))


def _task_names(tree: ast.AST) -> list[str]:
    names = []
    for node in _preorder(tree):
        if isinstance(node, ast.Call):
            called = _name(node.func)
            if called.endswith("Operator") or any(part in called for part in TASK_CLASSES):
                given = (_constant(k.value, str) for k in node.keywords if k.arg == "task_id")
                names.extend(filter(None, given))
        elif isinstance(node, DEFS):
            marks = (d.func if isinstance(d, ast.Call) else d for d in node.decorator_list)
            names.extend(node.name for mark in marks if _name(mark) == "task")
    return names


def _owner_nodes(given: dict[str, ast.AST]) -> Iterator[ast.AST]:
    """Where an owner may be named: the argument itself, or its entry in the defaults."""
    for key, node in given.items():
        if key == "owner":
            yield node
        elif key == "default_args" and isinstance(node, ast.Dict):
            yield from (v for k, v in zip(node.keys, node.values) if _constant(k, str) == "owner")


def _settings(call: ast.Call) -> dict:
    """What the arguments of a definition say as constants; what they leave out is absent."""
    given = {k.arg: k.value for k in call.keywords}
    texts = {key: _constant(node, str) for key, node in given.items()}
    first = _constant(call.args[0], str) if call.args else None
    said = {"owners": [o for o in (_constant(n, str) for n in _owner_nodes(given)) if o]}
    if first or "dag_id" in given:
        said["dag_id"] = texts.get("dag_id") or first or None
    timing = [key for key in given if key in ("schedule", "schedule_interval")]
    if timing:
        said["schedule"] = texts[timing[-1]] or ""
    if "description" in given:
        said["description"] = texts["description"] or ""
    if "tags" in given:
        items = getattr(given["tags"], "elts", []) if isinstance(given["tags"], (ast.List, ast.Tuple)) else []
        said["tags"] = [text for text in (_constant(i, str) for i in items) if text is not None]
    numbers = {"catchup": bool, "max_active_runs": int}
    for key, kind in numbers.items():
        value = _constant(given.get(key), kind)
        if value is not None and abs(value) < 2**63:
            said[key] = kind(value)
    return said


def _definitions(tree: ast.AST) -> Iterator[dict]:
    """Definitions by call, and by decorator; calls inside functions are not seen."""
    for node in _preorder(tree, closed=DEFS):
        if isinstance(node, ast.Call) and _name(node.func) == "DAG":
            said = _settings(node)
            if said.get("dag_id"):
                yield said
        elif isinstance(node, DEFS):
            for mark in node.decorator_list:
                bare = isinstance(mark, ast.Name) and mark.id == "dag"
                if bare or (isinstance(mark, ast.Call) and _name(mark.func) == "dag"):
                    said = {"owners": []} if bare else _settings(mark)
                    said.setdefault("dag_id", node.name)
                    said.setdefault("description", ast.get_docstring(node) or "")
                    yield said


def _unreadable(error: Exception) -> str | None:
    """Why no rule can read a file; none if the error says nothing about the file."""
    if isinstance(error, MemoryError):  # the parser's own stack, not the task's memory
        return "nested too deeply" if "stack overflow" in str(error) else None
    return "nested too deeply" if isinstance(error, RecursionError) else str(error)


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_ord", "path", "dag_ord", *FIELDS, "unparsed", "skipped"]
    for batch in batches:
        rows = []
        for file_ord, path, content in batch.itertuples(index=False, name=None):
            try:
                tree = ast.parse(content)
                tasks = _task_names(tree)
                found = [{"tasks": tasks, **said} for said in _definitions(tree)]
            except SyntaxError:
                found = []
            except (RecursionError, MemoryError, ValueError) as error:
                if (reason := _unreadable(error)) is None:
                    raise
                rows.append((file_ord, path, 0, *[None] * len(FIELDS), None, reason))
                continue
            for number, said in enumerate(found):
                rows.append((file_ord, path, number, *map(said.get, FIELDS), None, None))
            if not found:
                rows.append((file_ord, path, 0, *[None] * len(FIELDS), content, None))
        out = pd.DataFrame(rows, columns=columns)
        out["max_active_runs"] = out["max_active_runs"].astype("Int64")
        out["catchup"] = out["catchup"].astype("boolean")
        yield out


def _first_match(text: str, patterns: tuple[str, ...]) -> Column:
    tries = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*tries)


def pattern_fields(text: str) -> dict[str, Column]:
    """The pieces of a definition that patterns alone can find."""
    return {
        "dag_id": _first_match(text, ID_PATTERNS),
        "schedule": _first_match(text, SCHEDULE_PATTERNS),
        "tasks": F.regexp_extract_all(text, F.lit(TASK_ID), 1),
        "owners": F.regexp_extract_all(text, F.lit(OWNER), 1),
        "tags": F.regexp_extract_all(F.regexp_extract(text, TAG_LIST, 1), F.lit(TAG), 1),
    }


def with_defaults(dags: DataFrame) -> DataFrame:
    """Unique lists in first-seen order, and defaults for what a definition leaves out."""
    empty = F.array().cast("array<string>")
    for name in ("tasks", "owners", "tags"):
        dags = dags.withColumn(name, F.array_distinct(F.coalesce(name, empty)))
    runs = F.col("max_active_runs")
    return (
        dags.na.fill("", ["schedule", "description"])
        .na.fill(False, ["catchup"])
        .withColumn("max_active_runs", F.when(runs != 0, runs).otherwise(F.lit(1)))
    )


def workflow_files(files: DataFrame) -> DataFrame:
    """Only ``.py`` files that look like workflow definitions reach the Python workers."""
    return files.where(
        (extension(F.col("path")) == ".py")
        & has_text(F.col("content"))
        & is_workflow_file(F.col("content"))
    )


def read_workflows(files: DataFrame) -> DataFrame:
    """What syntax trees say about every workflow file, in one pass.

    A file without definitions keeps its text in ``unparsed``; one that cannot be read has
    a reason in ``skipped``. Numbers beyond 64 bits count as left out.
    """
    order_type = files.schema["file_ord"].dataType.simpleString()
    return (
        workflow_files(files)
        .select("file_ord", "path", "content")
        .mapInPandas(
            _read_files,
            f"file_ord {order_type}, path string, dag_ord int, {PARSED}, unparsed string, skipped string",
        )
    )


def skipped_files(read: DataFrame) -> DataFrame:
    """(path, reason) of the files that could not be read."""
    return read.where(F.col("skipped").isNotNull()).select("path", F.col("skipped").alias("reason"))


def parse_workflows(files: DataFrame) -> DataFrame:
    """All workflow definitions of a corpus, from syntax trees or else from patterns."""
    return definitions(read_workflows(files))


def definitions(read: DataFrame) -> DataFrame:
    """The definitions among what was read, those of files without a syntax tree by patterns."""
    by_pattern = pattern_fields("unparsed")
    fields = [
        F.when(F.col("unparsed").isNotNull(), by_pattern[name]).otherwise(F.col(name)).alias(name)
        if name in by_pattern
        else F.col(name)
        for name in FIELDS
    ]
    found = read.where(F.col("skipped").isNull()).select(
        "file_ord",
        "dag_ord",
        F.col("path").alias("source_file"),
        *fields,
        F.col("unparsed").isNull().alias("by_syntax"),
    ).where(F.col("by_syntax") | F.col("dag_id").isNotNull())
    return with_defaults(found)


def pattern_workflows(files: DataFrame) -> DataFrame:
    """Definitions found by patterns alone, for every workflow file."""
    found = workflow_files(files).select(
        "file_ord",
        F.lit(0).alias("dag_ord"),
        F.col("path").alias("source_file"),
        *(column.alias(name) for name, column in pattern_fields("content").items()),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("boolean").alias("catchup"),
        F.lit(None).cast("long").alias("max_active_runs"),
    )
    return with_defaults(found.where(F.col("dag_id").isNotNull()))


def registry(dags: DataFrame) -> DataFrame:
    """One row per id: the last definition wins. Definitions without an id stay apart."""
    place = F.struct("file_ord", "dag_ord")
    payload = F.struct(
        "dag_id", "schedule", "tasks", "owners", "tags", "source_file", "description",
        "catchup", "max_active_runs",
    )
    return (
        dags.groupBy("dag_id", F.when(F.col("dag_id").isNull(), place).alias("unnamed"))
        .agg(F.max_by(payload, place).alias("last"))
        .select("last.*")
    )


def exploded(registry: DataFrame, items: str) -> DataFrame:
    """One row per task, owner or tag; a workflow without any keeps one row."""
    return registry.select("dag_id", F.posexplode_outer(items).alias("pos", "item"))
