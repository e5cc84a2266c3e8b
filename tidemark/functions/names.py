"""Predicates and labels on paths, table names and column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.vocab import CODE_EXTENSIONS, PII_WORDS, SKIPPED_FOLDERS, SQL_KEYWORDS


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of a name start none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def file_type(path: Column) -> Column:
    return (
        F.when(path.endswith(".py"), "python")
        .when(path.endswith(".sql"), "sql")
        .when(path.endswith(".yml") | path.endswith(".yaml"), "yaml")
        .when(path.endswith(".md"), "markdown")
        .otherwise("text")
    )


def is_code_path(path: Column) -> Column:
    """Eligible extension and no skipped folder above the file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.array(*map(F.lit, SKIPPED_FOLDERS))
    return extension(path).isin(*CODE_EXTENSIONS) & ~F.arrays_overlap(folders, skipped)


def basename(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("—"))


def is_keyword(name: Column) -> Column:
    return F.upper(name).isin(*SQL_KEYWORDS)


def is_table_name(name: Column) -> Column:
    return (
        F.length(name).between(2, 64)
        & name.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")
        & ~is_keyword(name)
    )


def pii_types(column: Column) -> Column:
    """All PII words inside a column name, sorted."""
    words = F.array(*map(F.lit, sorted(PII_WORDS)))
    return F.filter(words, lambda word: F.contains(F.lower(column), word))


def is_pii(column: Column) -> Column:
    return F.lower(column).rlike("|".join(PII_WORDS))
