"""Tables, columns and lineage edges mined from a corpus of SQL and Python files.

Every step maps files to rows; order columns (file_ord, part, text_ord, block_ord,
src_ord) carry the reading order, so nothing depends on the order of partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import extension, is_keyword, is_pii, is_table_name, pii_types
from tidemark.functions.text import SPACE_CLASS, has_text, strip
from tidemark.vocab import LOAD_SUFFIXES, NON_COLUMN_PREFIXES

# Patterns that decide what counts as a statement, source or target.
QUOTED_TEXT = r"(?s)(?:\"\"\"|''')(.*?)(?:\"\"\"|''')"
SQL_WORD = r"(?iU)\b(SELECT|INSERT|CREATE|UPDATE|DELETE)\b"
TABLE_HEAD = (
    r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"(?:\w+\.)?(?:\"(\w+)\"|`(\w+)`|\[(\w+)\]|(\w+))\s*\("
)
INSERT_START = r"(?iU)(?=INSERT\s+(?:OR\s+\w+\s+)?INTO\s)"
INSERT_TARGET = r"^(?iUs)INSERT\s+(?:OR\s+\w+\s+)?INTO\s+(?:\w+\.)?(\w+)\b(.*)"
SELECT_PART = r"(?iUs)\bSELECT\b.*?(?:;|\z)"
SELECT_WORD = r"(?iU)\bSELECT\b"
SOURCE = r"(?iU)(?:FROM|JOIN)\s+(?:\w+\.)?(\w+)"
# A word is tried once, from its start: encoded data is one word of any length.
ASSIGNED_TEXT = r"(?Us)(?<!\w)(\w++)\s*+=\s*+\(?+\s*+(?:\"\"\"|''')(.*?)(?:\"\"\"|''')\s*\)?"
ASSIGNED_SOURCE = r"(?iU)(?:FROM|JOIN)\s+\(?(?:\w+\.)?(\w+)(?:\s+(?:AS\s+)?\w+)?"

QUOTES = "`\"[]"
EDGE_ORDER = ("file_ord", "part", "text_ord", "block_ord", "src_ord")


def sql_texts(files: DataFrame) -> DataFrame:
    """Whole ``.sql`` files and the SQL-like triple-quoted strings of ``.py`` files."""
    kind = extension(F.col("path"))
    texts = F.when(kind == ".sql", F.array("content")).otherwise(
        F.regexp_extract_all("content", F.lit(QUOTED_TEXT), 1)
    )
    return (
        files.where(kind.isin(".sql", ".py") & has_text(F.col("content")))
        .select("file_ord", "path", kind.alias("kind"), F.posexplode(texts).alias("text_ord", "sql"))
        .where((F.col("kind") == ".sql") | F.col("sql").rlike(SQL_WORD))
        .drop("kind")
    )


def _closings(sql: str) -> dict[int, int]:
    """Position of the closing partner of each opening parenthesis that has one."""
    partner, waiting = {}, []
    for found in re.finditer(r"[()]", sql):
        if found[0] == "(":
            waiting.append(found.start())
        elif waiting:
            partner[waiting.pop()] = found.start()
    return partner


def _items(body: str) -> list[str]:
    """Pieces between the commas that lie outside all parentheses."""
    cuts, depth = [-1], 0
    for found in re.finditer(r"[(),]", body):
        if found[0] == ",":
            if depth == 0:
                cuts.append(found.start())
        else:
            depth += 1 if found[0] == "(" else -1
    cuts.append(len(body))
    return [body[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def _block_reader(head: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heading = re.compile(head, re.IGNORECASE)
        for batch in batches:
            rows = []
            for file_ord, path, text_ord, sql in batch.itertuples(index=False, name=None):
                partner = _closings(sql)
                for number, found in enumerate(heading.finditer(sql)):
                    end = partner.get(found.end() - 1)
                    if end is not None:
                        name = next(filter(None, found.groups()))
                        rows.append((file_ord, path, text_ord, number, name, _items(sql[found.end() : end])))
            yield pd.DataFrame(rows, columns=["file_ord", "path", "text_ord", "block_ord", "name", "items"])

    return read


def create_table_blocks(texts: DataFrame) -> DataFrame:
    """One row per CREATE TABLE with a balanced body: name, body and its items."""
    order_type = texts.schema["file_ord"].dataType.simpleString()
    return (
        texts.where(F.col("sql").rlike(r"(?iU)CREATE\s"))
        .select("file_ord", "path", "text_ord", "sql")
        .mapInPandas(
            _block_reader(TABLE_HEAD),
            f"file_ord {order_type}, path string, text_ord int, block_ord int, "
            "name string, items array<string>",
        )
        .where(is_table_name(F.col("name")))
        .withColumn("body", F.array_join("items", ","))
    )


def _column_names(items: Column) -> Column:
    """Column names of the items of a body, without keys, checks and comments.

    One small step after the other: inside array functions a shared expression would
    be evaluated once per use.
    """
    other = "^(?:" + "|".join(p.replace("*", r"\*") for p in NON_COLUMN_PREFIXES) + ")"
    kept = F.filter(F.transform(items, strip), lambda i: ~F.upper(i).rlike(other))
    tokens = F.transform(kept, lambda i: F.regexp_extract(i, f"^[^{SPACE_CLASS}]*", 0))
    allowed = F.filter(
        tokens, lambda t: t.rlike(r"^[`\"\[]") | ~is_keyword(F.translate(t, QUOTES, ""))
    )
    bare = F.transform(allowed, lambda t: F.translate(t, QUOTES, ""))
    return F.filter(bare, lambda c: c.rlike("^[a-zA-Z_]"))


def table_definitions(blocks: DataFrame) -> DataFrame:
    """Column list of every block."""
    return blocks.select(
        "file_ord", "path", "text_ord", "block_ord", "name", _column_names(F.col("items")).alias("columns")
    )


def tag_pii(tables: DataFrame) -> DataFrame:
    """Add the PII columns among ``columns`` with their types."""
    tagged = F.transform(
        F.filter("columns", is_pii),
        lambda c: F.struct(c.alias("column"), pii_types(c).alias("pii_types")),
    )
    return tables.withColumn("pii_columns", tagged)


def _joined_names(text: Column) -> Column:
    """Lower-cased names right after JOIN, and those after its schema qualifier.

    Look-ahead leaves the text unread, so a JOIN inside another match still counts.
    """
    first = F.regexp_extract_all(text, F.lit(r"(?iU)\bJOIN(?=\s+(\w+))"), 1)
    second = F.regexp_extract_all(text, F.lit(r"(?iU)\bJOIN(?=\s+\w+\.(\w+))"), 1)
    return F.transform(F.concat(first, second), F.lower)


def _to_edges(statements: DataFrame, text: str, pattern: str, part: int) -> DataFrame:
    """One row per source name found in ``text``, labelled by how it is read."""

    def labelled(name: Column) -> Column:
        joined = F.array_contains("joined", F.lower(name))
        return F.struct(
            name.alias("source"),
            F.when(joined, "JOIN").otherwise("INSERT_SELECT").alias("transformation"),
        )

    sources = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), labelled)
    return (
        statements.withColumn("joined", _joined_names(F.col(text)))
        .select(
            "file_ord",
            F.lit(part).alias("part"),
            "text_ord",
            "block_ord",
            F.posexplode(sources).alias("src_ord", "found"),
            "target",
            F.col("path").alias("file"),
        )
        .select(*EDGE_ORDER, "found.source", "target", "found.transformation", "file")
        .where(is_table_name(F.col("source")) & (F.upper("source") != F.upper("target")))
    )


def insert_edges(texts: DataFrame) -> DataFrame:
    """Edges of INSERT statements: every FROM/JOIN name feeds the target."""
    statements = (
        texts.where(F.col("sql").rlike(r"(?iU)INSERT\s"))
        .select(
            "file_ord",
            "path",
            "text_ord",
            F.posexplode(F.split("sql", INSERT_START)).alias("block_ord", "block"),
        )
        .withColumn("target", F.regexp_extract("block", INSERT_TARGET, 1))
        .where(is_table_name(F.col("target")))
        .withColumn("rest", F.regexp_extract("block", INSERT_TARGET, 2))
        .withColumn("select_part", F.regexp_extract("rest", SELECT_PART, 0))
        .withColumn(
            "search",
            F.when(F.col("select_part") != "", F.col("select_part")).otherwise(F.col("rest")),
        )
    )
    return _to_edges(statements, "search", SOURCE, part=0)


def variable_edges(files: DataFrame) -> DataFrame:
    """Edges of load statements kept in variables named after their target."""
    texts = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(ASSIGNED_TEXT), 1).alias("variable"),
        F.regexp_extract_all("content", F.lit(ASSIGNED_TEXT), 2).alias("body"),
    )
    suffix = f"(?:{'|'.join(LOAD_SUFFIXES)})$"
    statements = (
        files.where((extension(F.col("path")) == ".py") & has_text(F.col("content")))
        .select("file_ord", "path", F.posexplode(texts).alias("text_ord", "found"))
        .select(
            "file_ord",
            "path",
            "text_ord",
            F.lit(0).alias("block_ord"),
            F.lower("found.variable").alias("variable"),
            F.col("found.body").alias("body"),
        )
        .where(F.col("variable").rlike("_insert|_load|_upsert") & F.col("body").rlike(SELECT_WORD))
        .withColumn("target", F.regexp_replace("variable", suffix, ""))
        .where((F.col("target") != "") & ~is_keyword(F.col("target")))
    )
    return _to_edges(statements, "body", ASSIGNED_SOURCE, part=1)


def raw_edges(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All edges of a corpus in reading order columns, before names are resolved."""
    texts = sql_texts(files) if texts is None else texts
    return insert_edges(texts).unionByName(variable_edges(files))
