"""Delimited text files, every cell a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import has_text, strip
from tidemark.session import materialise

# Line ends besides those the text source splits at. The record separator is one of
# them, so no line holds it and it can stand for the delimiter between fields.
OTHER_LINE_ENDS = r"[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
FIELD_END = "\x1e"


def _fields(line: Column, delimiter: str) -> Column:
    """Fields of a line: quotes switch quoting on and off and are dropped.

    Between quotes (every second piece) the delimiter is left as text.
    """
    pieces = F.transform(
        F.split(line, '"'),
        lambda piece, i: F.when(i % 2 == 0, F.translate(piece, delimiter, FIELD_END)).otherwise(piece),
    )
    return F.transform(F.split(F.array_join(pieces, ""), FIELD_END), strip)


def _unique(names: list[str]) -> list[str]:
    """Usable column names: blank ones are numbered, repeated ones get a suffix."""
    taken, out = {"row_id"}, []
    for place, name in enumerate(names):
        name = base = name or f"_c{place}"
        number = 2
        while name.lower() in taken:
            name, number = f"{base}_{number}", number + 1
        taken.add(name.lower())
        out.append(name)
    return out


def _plan_of(heads: list[str], fields: list[list[str]]) -> tuple[list[str], list[tuple[str, list[int]]]]:
    """Column names, and for every header line the place of each column in it."""
    named = [_unique(f) for f in fields]
    names = named[0]
    for head, own in zip(heads, named):
        if sorted(own) != sorted(names):
            raise ValueError(f"columns differ: {own} and {names}")
    return names, [(head, [own.index(n) for n in names]) for head, own in zip(heads, named)]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of files, as string columns plus ``row_id``.

    The first line of each file names its columns, in any order; all files need the same
    ones, and the first file's order holds. ``,`` or ``;``, whichever the file's first line
    has more of. Lines that are not valid UTF-8 are read as Latin-1. Blank lines are left
    out, short rows filled with empty cells, long ones cut.

    The header lines are read from the first split of each file; their different forms
    are few and go into the plan, the files' forms are joined by file.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are supported")
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.when(F.is_valid_utf8("value"), F.col("value"))
        .otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("value"),
    )
    lines = raw.select(
        "file", "block", "line_no", F.posexplode(F.split("value", OTHER_LINE_ENDS)).alias("piece", "line")
    ).select("file", F.struct("file", "block", "line_no", "piece").alias("row_id"), "line")
    # One short row per file.
    heads = materialise(
        lines.where(F.col("row_id.block") == 0).groupBy("file").agg(
            F.min(F.struct(F.col("row_id.line_no").alias("line_no"), F.col("row_id.piece").alias("piece"), "line")).alias("head")
        ),
        "file-heads",
    )
    delimiter = F.when(F.regexp_count("head.line", F.lit(",")) >= F.regexp_count("head.line", F.lit(";")), ",").otherwise(";")
    forms = (
        heads.withColumn("delimiter", delimiter).groupBy("head.line", "delimiter").agg(F.min("file").alias("file"))
        .orderBy("file").collect()
    )
    if not forms:
        raise ValueError("the file is empty")
    cut = spark.createDataFrame([(i, f["line"], f["delimiter"]) for i, f in enumerate(forms)], "i int, line string, delimiter string")
    fields = [
        row["f"] for row in cut.select("i", F.when(F.col("delimiter") == ",", _fields(F.col("line"), ",")).otherwise(_fields(F.col("line"), ";")).alias("f"))
        .orderBy("i").collect()
    ]
    names, places = _plan_of([f["line"] for f in forms], fields)
    shape = spark.createDataFrame(
        [(head, form["delimiter"], place) for form, (head, place) in zip(forms, places)], "form string, delimiter string, places array<int>"
    )
    known = heads.join(shape, F.col("head.line") == F.col("form")).select(
        F.col("file").alias("of"), "delimiter", "places", F.col("head.line_no").alias("head_no"), F.col("head.piece").alias("head_piece")
    )
    body = (
        lines.join(known, F.col("file") == F.col("of"))
        .where((F.col("row_id.block") != 0) | (F.col("row_id.line_no") != F.col("head_no")) | (F.col("row_id.piece") != F.col("head_piece")))
        .where(has_text(F.col("line")))
    )
    fields = F.when(F.col("delimiter") == ",", _fields(F.col("line"), ",")).otherwise(_fields(F.col("line"), ";"))
    return body.withColumn("fields", fields).select(
        "row_id",
        *(F.coalesce(F.get("fields", F.get("places", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)),
    )
