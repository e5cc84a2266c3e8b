"""The table catalog: merging definitions, listing, searching, auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import basename


def merge_definitions(definitions: DataFrame) -> DataFrame:
    """One row per table name: the widest definition, the earliest among equals.

    Within a file the last definition counts. The name keeps the place (``ordinal``)
    of its first file that has columns. Two aggregations with map-side partial
    results, no window, so a name defined in a third of all files stays cheap.
    """
    place = F.struct("text_ord", "block_ord")
    per_file = definitions.groupBy("name", "file_ord").agg(
        F.max_by(F.struct("columns", "path"), place).alias("last"),
        F.min(place).alias("first_place"),
    )
    with_columns = per_file.where(F.size("last.columns") > 0)
    at = F.struct("file_ord", "first_place.text_ord", "first_place.block_ord")
    # Smallest key = most columns, then first file.
    rank = F.struct((-F.size("last.columns")).alias("narrowness"), F.col("file_ord"))
    return (
        with_columns.groupBy("name")
        .agg(F.min_by("last", rank).alias("best"), F.min(at).alias("ordinal"))
        .select("name", "best.columns", F.col("best.path").alias("source_file"), "ordinal")
    )


def with_pii_flag(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("has_pii", F.size("pii_columns") > 0)


def listing(catalog: DataFrame) -> DataFrame:
    return (
        with_pii_flag(catalog)
        .select("name", "columns", "pii_columns", "source_file", "has_pii")
        .orderBy("name")
    )


def matches_search(query: str) -> Column:
    """Case-insensitive substring of the name, the file or any column."""
    wanted = F.lit(query.lower())
    return (
        F.contains(F.lower("name"), wanted)
        | F.coalesce(F.contains(F.lower("source_file"), wanted), F.lit(False))
        | F.exists("columns", lambda c: F.contains(F.lower(c), wanted))
    )


def matches_category(category: str) -> Column:
    tagged = F.size("pii_columns") > 0
    return {"pii": tagged, "clean": ~tagged, "rich": F.size("columns") > 0}.get(
        category, F.lit(True)
    )


def search(catalog: DataFrame, query: str = "", category: str = "all") -> DataFrame:
    return catalog.where(matches_search(query) & matches_category(category))


def lookup(catalog: DataFrame, name: str) -> DataFrame:
    """The columns of one table; an unknown name is an error."""
    found = catalog.where(F.col("name") == name).select("name", F.posexplode("columns").alias("pos", "column"))
    if found.isEmpty():
        raise KeyError(f"table {name!r} is not in the catalog")
    return found


def schema_preview(columns: Column) -> Column:
    """The first six columns and how many more there are."""
    more = F.concat(F.lit(" +"), (F.size(columns) - 6).cast("string"), F.lit(" more"))
    return F.concat(
        F.array_join(F.slice(columns, 1, 6), ", "),
        F.when(F.size(columns) > 6, more).otherwise(""),
    )


def pii_summary(pii_columns: Column) -> Column:
    return F.array_join(
        F.transform(
            pii_columns,
            lambda p: F.concat(p["column"], F.lit("("), F.array_join(p["pii_types"], "+"), F.lit(")")),
        ),
        " | ",
    )


def overview(catalog: DataFrame) -> DataFrame:
    """Display strings of every table."""
    return catalog.select(
        "name",
        basename(F.col("source_file")).alias("file"),
        schema_preview(F.col("columns")).alias("preview"),
        pii_summary(F.col("pii_columns")).alias("pii"),
    )


def column_tags(catalog: DataFrame) -> DataFrame:
    """Every column with its PII types, null where it has none.

    Both lists sit in the same row, so the lookup needs no join and no shuffle. A
    column listed twice is looked up twice; its last PII entry counts.
    """
    columns = catalog.select("name", "pii_columns", F.posexplode("columns").alias("pos", "column"))
    entries = F.filter("pii_columns", lambda p: p["column"] == F.col("column"))
    return columns.select(
        "name", "pos", "column", F.try_element_at(entries, F.lit(-1))["pii_types"].alias("pii_types")
    )


def pii_audit(catalog: DataFrame) -> DataFrame:
    """One row per PII column."""
    return catalog.select(
        F.col("name").alias("table"), "source_file", F.inline("pii_columns")
    )


def pii_totals(catalog: DataFrame) -> DataFrame:
    size = F.size("pii_columns")
    return catalog.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("pii_columns"),
        F.count_if(size > 0).alias("pii_tables"),
    )


def statistics(catalog: DataFrame) -> DataFrame:
    tagged = F.size("pii_columns") > 0
    return catalog.agg(
        F.count("*").alias("total"),
        F.count_if(tagged).alias("pii"),
        F.count_if(~tagged).alias("clean"),
        F.count_if(F.size("columns") > 0).alias("with_columns"),
    )
