"""Column profiles, duplicates, quality scores and issues of tables.

Profiles read text cells; a blank cell counts as missing. Per-column figures come
from one pass over (column number, cell) pairs, so wide tables need no job per column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import is_pii
from tidemark.functions.scoring import quality_band
from tidemark.functions.text import has_text, round_half_even, strip
from tidemark.session import materialise
from tidemark.vocab import DATE_FORMATS, FLOAT_PATTERN, INT_PATTERN, LOOSE_UNDERSCORE

# Shapes of the date formats, so that only likely dates are parsed.
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
)


def _cell(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def cells(table: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(pos, value): one row per cell under its column number, missing values as empty text.

    With ``weight``, that column of the row follows under this name.
    """
    kept = [] if weight is None else [_cell(weight).alias("weight")]
    wide = table.select(
        *kept, *(F.coalesce(_cell(c).cast("string"), F.lit("")).alias(str(i)) for i, c in enumerate(columns))
    )
    names = ["weight"] if kept else []
    return wide.unpivot(names, [str(i) for i in range(len(columns))], "pos", "value").select(
        F.col("pos").cast("int").alias("pos"), "value", *names
    )


def counted_cells(table: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Distinct cells with how often they occur; repeats combine before the shuffle.

    ``weight`` names a column that tells how often a row occurs, else each row is one.
    """
    times = F.count("*") if weight is None else F.sum("weight")
    return cells(table, columns, weight).groupBy("pos", "value").agg(times.alias("n"))


def distinct_rows(table: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """Distinct rows, and the name of the column that tells how often each occurs."""
    weight, taken = "n", {c.lower() for c in columns}
    while weight in taken:
        weight += "_"
    return table.groupBy(*(_cell(c) for c in columns)).agg(F.count("*").alias(weight)), weight


def _named(per_column: DataFrame, columns: list[str]) -> DataFrame:
    """Column names in place of mere numbers, on rows that are one per column."""
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("pos") + 1)
    return per_column.select("pos", name.alias("column"), *per_column.columns[1:])


def cell_class(value: Column) -> Column:
    """int, float, date, text, or null for a blank cell."""
    text = strip(value)
    dated = F.lit(False)
    for shape, form in zip(DATE_SHAPES, DATE_FORMATS):
        dated = dated | (
            F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).isNotNull())
            .otherwise(False)
        )
    return (
        F.when(text == "", None)
        .when(text.rlike(INT_PATTERN) & ~text.rlike(LOOSE_UNDERSCORE), "int")
        .when(text.rlike(FLOAT_PATTERN) & ~text.rlike(LOOSE_UNDERSCORE), "float")
        .when(dated, "date")
        .otherwise("text")
    )


def cell_number(value: Column) -> Column:
    """The number in an int or float cell."""
    text = F.replace(strip(value), F.lit("_"), F.lit(""))
    return F.when(F.lower(text).endswith("nan"), F.lit(float("nan"))).otherwise(
        text.try_cast("double")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(round_half_even(part / whole * 100.0, 2))


def null_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """Blank cells per column, and their percentage."""
    counts = (
        cells(table, columns)
        .groupBy("pos")
        .agg(F.count("*").alias("rows"), F.count_if(~has_text(F.col("value"))).alias("null_count"))
    )
    return _named(counts, columns).withColumn("null_pct", _share(F.col("null_count"), F.col("rows")))


def distinct_profile(table: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-blank cells per column, as a share of all rows."""
    filled = has_text(F.col("value"))
    if approximate:
        per_column = (
            cells(table, columns)
            .groupBy("pos")
            .agg(
                F.count("*").alias("rows"),
                F.approx_count_distinct(F.when(filled, F.col("value"))).alias("unique_count"),
            )
        )
    else:
        per_column = (
            counted_cells(table, columns)
            .groupBy("pos")
            .agg(F.sum("n").alias("rows"), F.count_if(filled).alias("unique_count"))
        )
    return _named(per_column, columns).withColumn("unique_pct", _share(F.col("unique_count"), F.col("rows")))


def _class_counts(weight: Column) -> list[Column]:
    def where(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, weight).otherwise(0))

    return [
        F.sum(F.when(F.col("kind").isNotNull(), weight).otherwise(0)).alias("filled"),
        where("int").alias("ints"),
        where("float").alias("floats"),
        where("date").alias("dates"),
    ]


def _verdict() -> Column:
    filled, ints, floats, dates = map(F.col, ("filled", "ints", "floats", "dates"))
    return (
        F.when(filled == 0, "unknown")
        .when(dates / filled > 0.7, "date")
        .when(ints / filled > 0.8, "integer")
        .when((ints + floats) / filled > 0.7, "float")
        .otherwise("string")
    )


def type_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """Inferred type per column and the cells that do not fit a numeric one.

    Classes are counted where the cells are read; only counts are shuffled.
    """
    counts = (
        cells(table, columns)
        .withColumn("kind", cell_class(F.col("value")))
        .groupBy("pos")
        .agg(*_class_counts(F.lit(1)))
    )
    return (
        _named(counts, columns)
        .withColumn("inferred_type", _verdict())
        .withColumn("type_mismatches", _mismatches())
    )


def _mismatches() -> Column:
    numeric = F.col("inferred_type").isin("integer", "float")
    return F.when(numeric, F.col("filled") - F.col("ints") - F.col("floats")).otherwise(0)


def _sort_bits():
    """The bits of a double as an unsigned number that sorts like the double."""

    @F.pandas_udf("long")
    def bits(values: pd.Series) -> pd.Series:
        raw = (values.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63))))

    return bits


def upper_medians(numbers: DataFrame, key: str = "column", value: str = "number", weight: str = "n") -> DataFrame:
    """Exact weighted upper median per key, by four rounds of radix selection.

    The 64 bits of a double, put in sorting order, are read 16 at a time: each round
    counts weights per leading digits (65,536 groups per key at most), finds the digit
    that holds the middle and goes on inside it. No round sorts or gathers the values.
    The digits are written once and read by each round.
    """
    keyed = numbers.select(key, weight, value, _sort_bits()(F.col(value)).alias("bits"))
    for number in range(4):
        digit = F.shiftrightunsigned("bits", 48 - 16 * number).bitwiseAND(F.lit(0xFFFF))
        keyed = keyed.withColumn(f"d{number}", digit)
    keyed = materialise(keyed.drop("bits"), "median-digits")
    rank = keyed.groupBy(key).agg(F.floor(F.sum(weight) / 2).alias("skip"))
    chosen, path = rank, [key]
    for number in range(4):
        path = [*path, f"d{number}"]
        counts = (
            keyed.join(chosen, path[:-1])
            .groupBy(*path, "skip")
            .agg(F.sum(weight).alias("w"), F.min(value).alias(value))
        )
        upto = Window.partitionBy(key).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("before", F.sum("w").over(upto) - F.col("w"))
        inside = (F.col("before") <= F.col("skip")) & (F.col("skip") < F.col("before") + F.col("w"))
        last = [F.col(value).alias("median")] if number == 3 else []
        chosen = running.where(inside).select(*path, (F.col("skip") - F.col("before")).alias("skip"), *last)
    return chosen.select(key, "median")


def _deviations(numbers: DataFrame, types: DataFrame) -> DataFrame:
    """Population deviation per column, from the gaps to its mean."""
    # One row per column, so broadcasting is safe.
    means = F.broadcast(types.select("pos", "mean"))
    gap = F.col("number") - F.col("mean")
    return (
        numbers.join(means, "pos")
        .groupBy("pos")
        .agg(F.sqrt(F.sum(gap * gap * F.col("n")) / F.sum("n")).alias("std"))
    )


def profile(table: DataFrame, columns: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Full profile, one row per column. ``weight`` names a column with the number of times a row occurs.

    The classes, numbers and counts of distinct cells are written once, without the
    texts; types, distinct counts and numeric figures are read from there.
    """
    columns = columns or [c for c in table.columns if c != weight]
    kind, number = F.col("kind"), F.col("number")
    counted = materialise(
        counted_cells(table, columns, weight)
        .withColumn("kind", cell_class(F.col("value")))
        .select("pos", "kind", F.when(kind.isin("int", "float"), cell_number(F.col("value"))).alias("number"), "n"),
        "cells",
    )
    types = materialise(
        counted.groupBy("pos")
        .agg(
            F.sum("n").alias("rows"),
            F.count("kind").alias("unique_count"),
            *_class_counts(F.col("n")),
            F.min("number").alias("min"),
            F.max("number").alias("max"),
            (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
        )
        .withColumn("inferred_type", _verdict())
        .withColumn("type_mismatches", _mismatches())
        .withColumn("null_count", F.col("rows") - F.col("filled")),
        "column-types",
    )
    numeric = types.where(F.col("inferred_type").isin("integer", "float"))
    numbers = counted.where(number.isNotNull()).join(F.broadcast(numeric.select("pos")), "pos", "left_semi")
    stats = (
        numeric.select("pos", "min", "max", "mean")
        .join(_deviations(numbers, numeric), "pos")
        .join(upper_medians(numbers, key="pos"), "pos")
        .select("pos", F.struct(
            *(round_half_even(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std", "median"))
        ).alias("numeric_stats"))
    )
    return _named(types.drop("min", "max", "mean").join(stats, "pos", "left"), columns).select(
        "pos",
        F.col("column").alias("name"),
        "inferred_type",
        "rows",
        "null_count",
        _share(F.col("null_count"), F.col("rows")).alias("null_pct"),
        "unique_count",
        _share(F.col("unique_count"), F.col("rows")).alias("unique_pct"),
        "type_mismatches",
        is_pii(F.col("column")).alias("is_pii"),
        "numeric_stats",
    )


def duplicate_rows(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, and rows that repeat an earlier one. Equal rows combine before the shuffle."""
    return repeats(*distinct_rows(table, columns or table.columns))


def repeats(rows: DataFrame, weight: str) -> DataFrame:
    """The same from distinct rows and how often each occurs."""
    return rows.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col(weight) - 1), F.lit(0)).alias("duplicate_rows"),
    )


def quality_summary(profiled: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Totals and the quality score of a profiled table."""
    totals = profiled.agg(
        F.count("*").alias("total_columns"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_nulls"),
        F.coalesce(F.sum("type_mismatches"), F.lit(0)).alias("total_mismatches"),
    )
    rows, cell_count = F.col("total_rows"), F.col("total_rows") * F.col("total_columns")

    def penalty(part: str, whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(F.col(part) / whole)

    left = (
        1.0
        - penalty("total_nulls", cell_count)
        - penalty("duplicate_rows", rows)
        - F.col("total_mismatches") / F.greatest(cell_count, F.lit(1))
    )
    duplicate_count = duplicates.select("duplicate_rows").scalar()
    row_count = duplicates.select("total_rows").scalar()
    return (
        totals.withColumn("total_rows", row_count)
        .withColumn("duplicate_rows", duplicate_count)
        .withColumn("quality_score", round_half_even(F.greatest(F.lit(0.0), left) * 100.0, 2))
        .withColumn("quality_band", quality_band(F.col("quality_score")))
    )


def issues(profiled: DataFrame, summary: DataFrame) -> DataFrame:
    """Findings in fixed order. Column lists hold one entry per column of the table."""

    def names(rows: DataFrame, lead: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
        found = rows.agg(F.transform(ordered, lambda r: r["name"]).alias("names"))
        return found.where(F.size("names") > 0).select(
            F.concat(F.lit(lead), F.array_join("names", ", ")).alias("message")
        )

    def as_issue(rows: DataFrame, place: int, severity: Column | str, pos: Column | None = None) -> DataFrame:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return rows.select(
            F.lit(place).alias("place"),
            (F.lit(0) if pos is None else pos).alias("pos"),
            level.alias("severity"),
            "message",
        )

    copies = F.col("duplicate_rows")
    repeated = summary.where(copies > 0).withColumn(
        "message", F.concat(copies.cast("string"), F.lit(" duplicate rows detected"))
    )
    misfit = profiled.where(F.col("type_mismatches") > 0).withColumn(
        "message",
        F.concat(
            F.lit("Type mismatches in '"), "name", F.lit("': "),
            F.col("type_mismatches").cast("string"), F.lit(" non-"), "inferred_type", F.lit(" values"),
        ),
    )
    good = summary.where(F.col("quality_score") >= 95).withColumn(
        "message", F.lit("Data quality looks excellent!")
    )
    many = F.when(copies > F.col("total_rows") * 0.01, "error").otherwise("warning")
    parts = [
        as_issue(names(profiled.where(F.col("null_pct") > 5), "High null rate (>5%) in: "), 1, "warning"),
        as_issue(repeated, 2, many),
        as_issue(misfit, 3, "warning", F.col("pos")),
        as_issue(names(profiled.where("is_pii"), "PII detected in: "), 4, "info"),
        as_issue(good, 5, "success"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def quality_check(table: DataFrame, name: str, expected: dict[str, str] | None = None) -> DataFrame:
    """Nulls, duplicates and values that do not fit an expected type, in one row.

    ``expected`` maps columns to Spark types; a value that cannot be cast is a mismatch.
    One pass counts nulls and misfits, one grouping counts duplicates.
    """
    expected = expected or {}
    columns = table.columns
    misfits = [
        F.count_if(_cell(c).isNotNull() & _cell(c).try_cast(t).isNull()).alias(f"misfit {i}")
        for i, (c, t) in enumerate(expected.items())
    ]
    counted = table.agg(
        F.count("*").alias("total_rows"),
        F.map_from_arrays(
            F.array(*map(F.lit, columns)),
            F.array(*(F.count_if(_cell(c).isNull()) for c in columns)),
        ).alias("null_counts"),
        *misfits,
    )
    kinds = dict(table.dtypes)
    entry = "array<struct<column:string,expected_type:string,actual_type:string,rows_affected:bigint>>"
    mismatches = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"), F.lit(t).alias("expected_type"),
                F.lit(kinds[c]).alias("actual_type"), F.col(f"`misfit {i}`").alias("rows_affected"),
            )
            for i, (c, t) in enumerate(expected.items())
        )
    ).cast(entry)
    nulls = null_total(F.col("null_counts"))
    copies = duplicate_rows(table).select("duplicate_rows").scalar()
    space = F.greatest(F.col("total_rows") * len(columns), F.lit(1))
    score = (1.0 - (nulls + F.col("duplicate_rows")) / space) * 100.0
    return (
        counted.withColumn("duplicate_rows", copies)
        .withColumn("schema_mismatches", F.filter(mismatches, lambda m: m["rows_affected"] > 0))
        .select(
            F.lit(name).alias("table"),
            "total_rows",
            "null_counts",
            "duplicate_rows",
            "schema_mismatches",
            round_half_even(score, 2).alias("quality_score"),
            ((F.col("duplicate_rows") == 0) & (nulls == 0) & (F.size("schema_mismatches") == 0)).alias("passed"),
            F.current_timestamp().alias("checked_at"),
        )
    )


def null_total(null_counts: Column) -> Column:
    return F.aggregate(F.map_values(null_counts), F.lit(0).cast("long"), lambda a, b: a + b)


def null_shares(check: DataFrame) -> DataFrame:
    """One row per column of a quality check, with its share of missing values."""
    return check.select("table", "total_rows", F.explode("null_counts").alias("column", "null_count")).select(
        "table",
        "column",
        "null_count",
        (F.col("null_count") / F.greatest("total_rows", F.lit(1))).alias("null_share"),
    )


def preview(table: DataFrame, order: str, rows: int = 10) -> DataFrame:
    """The first rows as header-to-value maps, in ``order``."""
    shown = [c for c in table.columns if c != order]
    pairs = [part for c in shown for part in (F.lit(c), _cell(c))]
    return table.orderBy(order).limit(rows).select(order, F.create_map(*pairs).alias("row"))
