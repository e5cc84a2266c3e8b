"""Quality rules with thresholds learned per language and source, in DataFrame functions only.

Texts give integer measures. Fixed base rules come first; the texts that pass them feed
one quantile sketch per language, source and measure: a histogram over at most 1001
integer values, which merges by adding counts, has a proven size and gives the same
quantiles whatever the order. The quantiles of a group are averaged with those of its
language, and these with those of all texts, weighed by the texts behind them, so no
group is too small and thresholds move little with every text. A text is kept if every
measure lies within fences around the middle of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import settle

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
SYMBOLS = "#*$%&|<>"  # fixed values
SPACE = " \t\n\x0b\f\r"
PRIOR_TEXTS = 200  # texts that the wider sketch weighs as much as
REACH = 3  # fences lie this many times the spread beyond the 90th (10th) percentile
# Per measure the least distance of a fence from that percentile; the word length has a lower fence too.
MEASURES = {"repeated": 250, "symbols": 100, "dup_lines": 350, "word_length": 20}
TWO_SIDED = ("word_length",)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more: hashes are sorted with their
    places, and neighbours with equal hashes give the places of the words they cover."""
    size = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(rows: Column) -> Column:
            n = F.size(rows) - 1
            pairs = F.zip_with(F.slice(rows, 1, n), F.slice(rows, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            places = F.flatten(F.filter(pairs, lambda p: p.isNotNull()))
            return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(places), lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(_let(ordered, neighbours))

    return F.when(size < 4, F.lit(0)).otherwise(_let(hashes, covered))


def measures(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, lang, source) the counts of the base rules; null texts have none."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACE, "") != "")
    return found.select(
        "doc_id", "lang", "source",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(words, _repeated_words).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _features() -> dict[str, Column]:
    """Integer measures from 0 to 1000: parts in a thousand, and tenths of a character."""
    part = lambda n, of: F.least(F.expr(f"{n} * 1000 div greatest({of}, 1)"), F.lit(1000).cast("long"))
    return {
        "repeated": part("n_repeat_words", "n_words"),
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "word_length": F.least(F.expr("word_chars * 10 div greatest(n_words, 1)"), F.lit(1000).cast("long")),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, feature, value, n) over the rows that pass the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in _features().items())))
    return (
        measured.where(~F.col("base_failed")).select("lang", "source", pairs.alias("m"))
        .groupBy("lang", "source", "m.feature", "m.value").agg(F.count("*").alias("n"))
    )


QUANTILES = ("q10", "q50", "q90")


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per merged sketch and measure: texts and three quantiles."""
    merged = sketch.groupBy(*by, "feature", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "feature")
    ranked = merged.withColumns({"total": F.sum("n").over(group), "up_to": F.sum("n").over(group.orderBy("value"))})
    quantile = lambda q: F.min(F.when(F.col("up_to") * 100 >= F.col("total") * int(q[1:]), F.col("value")))
    return ranked.groupBy(*by, "feature").agg(F.max("total").alias("texts"), *(quantile(q).alias(q) for q in QUANTILES))


def _shrunk(own: str, wide: str, q: str) -> Column:
    """The average of a quantile with the wider sketch's, to the nearest whole number."""
    return F.expr(f"(2 * ({own}.texts * {own}.{q} + {PRIOR_TEXTS} * {wide}.{q}) + {own}.texts + {PRIOR_TEXTS}) div (2 * ({own}.texts + {PRIOR_TEXTS}))")


def fences(sketch: DataFrame) -> DataFrame:
    """Per language and source that have a sketch a low and a high fence of every measure."""
    every, wide, own = (quantiles(sketch, by) for by in ([], ["lang"], ["lang", "source"]))
    wide = wide.alias("w").join(every.alias("e"), "feature").select(
        F.col("w.lang").alias("l"), F.col("feature").alias("f"), *(_shrunk("w", "e", q).alias(q) for q in QUANTILES)
    )
    of_both = (F.col("o.lang").eqNullSafe(F.col("p.l"))) & (F.col("o.feature") == F.col("p.f"))
    found = own.alias("o").join(wide.alias("p"), of_both).select("o.lang", "o.source", "o.feature", *(_shrunk("o", "p", q).alias(q) for q in QUANTILES))
    least = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))[F.col("feature")]
    high = F.col("q90") + F.greatest(REACH * (F.col("q90") - F.col("q50")), least)
    low = F.when(F.col("feature").isin(*TWO_SIDED), F.col("q10") - F.greatest(REACH * (F.col("q50") - F.col("q10")), least)).otherwise(0)
    return found.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))))).alias("fences"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every row and whether it is kept.

    Nulls of language and source are groups of their own. A text without words fails the
    base rules. Repeated rows are judged alike; other columns are not read. No rows give
    no rows; a group none of whose texts pass the base rules needs no fences.
    """
    measured = settle(measures(docs), "quality-measures")
    sketch = settle(sketches(measured), "quality-sketches")
    chosen = settle(fences(sketch).withColumnsRenamed({"lang": "l", "source": "s"}), "quality-fences")
    joined = measured.join(chosen, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    within = F.lit(True)
    for name, value in _features().items():
        fence = F.col("fences")[name]
        within &= F.coalesce(value.between(fence["low"], fence["high"]), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("l", "s")
