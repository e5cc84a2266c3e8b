"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are runs of letters in lower case. A token is listed when labelled toxic
texts use it significantly more often; of the words left over, beginnings of six,
five and four letters are then tested in turn, so that unseen endings of a listed
stem count. A listed form scores its log-odds under a Dirichlet prior spread like
the labelled corpus; all other tokens share one slightly negative score, which
makes a text's score drift down between hits. A linear scan finds every maximal
segment, and extreme-value statistics (E = K n exp(-S)) say how surprising its
score S is in a text of n tokens. Passages add up their surprise, and a logistic
curve fitted on training labels turns the sum into a probability.

Near copies among the labelled texts (same smallest hash of five-word shingles)
train once, so a text copied often does not make its own words look toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_name, lowered_words, portions, settle, texts, tidied

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
SAMPLE_ROWS = 200_000  # labelled texts that train the list, the first by hash of their id
LISTED = 65_536  # entries of each of the four parts of the list, the surest first
PRIOR = 0.01  # weight of the prior, in parts of a class's tokens
CURVE_BINS = 400
MEMO_WORDS = 100_000  # distinct words a task remembers at a time
COUNTED_WORDS = 50_000  # distinct words whose counts a task holds


def forms(word: str) -> list[str]:
    """The word, then its beginnings, longest first."""
    return [word, *(f"{word[:size]}*" for size in STEMS if len(word) > size)]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    drift: float  # score of a token that is not listed, below zero
    k: float  # of the extreme-value law
    slope: float
    offset: float

    def evidence(self, segments: list[tuple[int, int, float]], n_tokens: int) -> float:
        """Sum of -ln E over passages that are rarer than once in a text like this."""
        floor = math.log(max(self.k * n_tokens, 1e-9))
        return sum(max(0.0, score - floor) for _, _, score in segments)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, self.slope * evidence + self.offset))))


class _Memo(dict):
    """Score of a word; 0 means that nothing about it is listed."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        found = next((self.scores[f] for f in forms(word) if f in self.scores), 0.0)
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found
        return found


def segments(hits: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), end exclusive.

    ``hits`` are the positions of tokens scored above zero; the others score
    ``drift``. Each candidate remembers the closest earlier one that starts from a
    lower running sum, so the whole scan takes linear time.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, earlier candidate
    total, position = 0.0, 0
    for at, score in zip(hits.tolist(), scores.tolist()):
        total += (at - position) * drift
        start, before = at, total
        total += score
        position = at + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, position, before, total, j))
    return [(start, end, after - before) for start, end, before, after, _ in found]


def _scan(words: list[str], memo: _Memo, drift: float) -> list[tuple[int, int, float]]:
    scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    hits = np.flatnonzero(scores)
    return segments(hits, scores[hits], drift)


def _tokens(text: bytes) -> list[str]:
    return LETTERS.findall(text.decode("utf-8", "replace").lower())


def _count(batches):
    """Per word of one task: occurrences and texts, by label; the row of no word has totals.

    Counts go out whenever they hold many words, so a word may have several rows.
    """
    uses, holders = (Counter(), Counter()), (Counter(), Counter())
    for batch in portions(batches):
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
            words = Counter(_tokens(text))
            uses[toxic].update(words)
            holders[toxic].update(words.keys())
            uses[toxic][""] += words.total()
            holders[toxic][""] += len(words)
        if len(uses[0]) + len(uses[1]) > COUNTED_WORDS:
            yield _counted(uses, holders)
            for counter in (*uses, *holders):
                counter.clear()
    yield _counted(uses, holders)


def _counted(uses: tuple[Counter, Counter], holders: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(uses[0].keys() | uses[1].keys())
    columns = {"word": pa.array(names, pa.string())}
    for name, counter in (("c0", uses[0]), ("c1", uses[1]), ("k0", holders[0]), ("k1", holders[1])):
        columns[name] = pa.array([counter[w] for w in names], pa.int64())
    return pa.record_batch(columns)


def _smallest_shingle(batches):
    hashes = _WordHash()
    for batch in portions(batches):
        found = []
        for text, row in zip(texts(batch), batch.column("row").to_pylist()):
            words = np.fromiter(map(hashes.__getitem__, lowered_words(text)), np.uint64, -1)
            size = min(5, len(words))
            mixed = sum((words[i : len(words) - size + 1 + i] * np.uint64(2 * i + 3) for i in range(size)), np.zeros(1, np.uint64))
            found.append(int((mixed * np.uint64(0x9E3779B97F4A7C15)).min().astype(np.int64)) if size else row)
        yield pa.record_batch([batch.column("row"), batch.column("toxic"), pa.array(found, pa.int64())], names=["row", "toxic", "mark"])


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(row, text, toxic) of labelled texts, near copies once.

    Both joins send at most ``sample_rows`` short rows to every task. A doc_id with
    several labels counts as toxic if one of them says so.
    """
    chosen = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = settle(rows.select(F.xxhash64("doc_id", "text").alias("row"), "text", "toxic"), "toxicity-sample")
    marks = rows.mapInArrow(tidied(_smallest_shingle), "row long, toxic int, mark long")
    first = settle(marks.groupBy("mark", "toxic").agg(F.min("row").alias("row")).select("row").distinct(), "toxicity-distinct")
    return rows.join(F.broadcast(first), "row", "left_semi")


def _listed(counts: DataFrame, size: int | None, t0: float, t1: float, n0: float, n1: float) -> list:
    """Forms of one length that toxic texts use significantly more often, the surest first.

    The log-likelihood ratio of two Poisson rates has to exceed what the best of as
    many forms would reach by chance.
    """
    form = F.col("word") if size is None else F.concat(F.substring("word", 1, size), F.lit("*"))
    grouped = counts if size is None else counts.where(F.length("word") > size)
    grouped = grouped.groupBy(form.alias("form")).agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "k0", "k1")))
    tested = grouped.agg(F.count("*").alias("n")).first()["n"]
    both, part = F.col("k0") + F.col("k1"), t1 / (t0 + t1)
    term = lambda k, share: F.when(k > 0, k * F.log(k / (both * share))).otherwise(0.0)
    ratio = 2 * (term(F.col("k1"), part) + term(F.col("k0"), 1 - part))
    mass = (F.col("c0") + F.col("c1")) / F.lit(n0 + n1)
    log1 = F.log((F.col("c1") + PRIOR * n1 * mass) / (n1 * (1 + PRIOR)))
    log0 = F.log((F.col("c0") + PRIOR * n0 * mass) / (n0 * (1 + PRIOR)))
    return (
        grouped.where(F.col("k1") > both * part).select("form", log1.alias("log1"), log0.alias("log0"), ratio.alias("ratio"))
        .where((F.col("ratio") > 2 * math.log(max(2, tested))) & (F.col("log1") > F.col("log0")))
        .orderBy(F.desc("ratio"), "form").limit(LISTED).collect()
    )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn list, drift, extreme-value constant and curve from labelled texts.

    Without a toxic and another text nothing is listed, and every text gets the
    share of toxic labels (one half without labels).
    """
    spark = docs.sparkSession
    sample = labelled(docs, labels, sample_rows)
    counts = settle(
        sample.mapInArrow(tidied(_count), "word string, c0 long, c1 long, k0 long, k1 long")
        .groupBy("word").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "k0", "k1"))),
        "toxicity-counts",
    )
    totals = counts.where("word = ''").first()
    n0, n1, t0, t1 = (max(1.0, float(totals[c])) if totals else 1.0 for c in ("c0", "c1", "k0", "k1"))
    left, found = counts.where("word <> ''"), []
    for size in (None, *STEMS):
        part = _listed(left, size, t0, t1, n0, n1)
        found += part
        if part:
            known = spark.createDataFrame([(r["form"],) for r in part], "form string")
            form = F.col("word") if size is None else F.concat(F.substring("word", 1, size), F.lit("*"))
            left = left.join(F.broadcast(known), form == F.col("form"), "left_anti")
    scores = {r["form"]: r["log1"] - r["log0"] for r in found}
    p1, p0 = (min(0.5, sum(math.exp(r[c]) for r in found)) for c in ("log1", "log0"))
    drift = min(-1e-3, math.log((1 - p1) / (1 - p0)))
    rough = Model(scores, drift, 1.0, 1.0, 0.0)

    def measure(batches):
        memo = _Memo(rough.scores)
        for batch in portions(batches):
            out = {"toxic": [], "n": [], "parts": []}
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                tokens = _tokens(text)
                out["toxic"].append(toxic)
                out["n"].append(max(1, len(tokens)))
                out["parts"].append([s for _, _, s in _scan(tokens, memo, rough.drift)])
            yield pa.record_batch([pa.array(out["toxic"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["parts"], pa.list_(pa.float64()))], names=list(out))

    measured = settle(sample.mapInArrow(tidied(measure), "toxic int, n long, parts array<double>"), "toxicity-measured")
    best = F.coalesce(F.array_max("parts"), F.lit(0.0))
    law = measured.where("toxic = 0").agg(F.count("*").alias("texts"), F.sum(F.col("n") * F.exp(-best)).alias("weight")).first()
    k = law["texts"] / law["weight"] if law["texts"] else 1.0
    surprise = F.aggregate("parts", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), s - F.log(F.lit(k) * F.col("n"))))
    bins = (
        measured.select("toxic", F.least(F.round(surprise * 10), F.lit(float(CURVE_BINS))).alias("bin"))
        .groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()
    )
    slope, offset = _curve([(r["bin"] / 10, r["toxic"], r["n"]) for r in bins])
    return Model(scores, drift, k, slope, offset)


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Ridge logistic regression of the label on evidence, from counts per bin."""
    if not bins:
        return 1.0, 0.0
    x, y, n = (np.array(c, float) for c in zip(*bins))
    design = np.stack([x, np.ones_like(x)], 1)
    beta, ridge = np.zeros(2), np.array([1.0, 0.1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


RESULT = "doc_id long, n_tokens long, passages array<struct<start:int,end:int,score:double,log_e:double>>, score double"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text): passages found, as token positions, and the probability.

    Only doc_id and text are read, so other columns may have any name. Null and empty
    texts have no passage and the score of no evidence. Repeated rows score alike.
    """
    return docs.select("doc_id", "text").mapInArrow(tidied(_scorer(model)), RESULT)


def _passages(text: bytes, model: Model, memo: _Memo) -> tuple[int, list[tuple[int, int, float]], float]:
    """Tokens of a text, its maximal segments, and the score above which one is a passage."""
    words = _tokens(text)
    return len(words), _scan(words, memo, model.drift), math.log(max(model.k * max(1, len(words)), 1e-9))


def _scorer(model: Model):
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64())])

    def run(batches):
        memo = _Memo(model.scores)
        for batch in portions(batches):
            sizes, found, scores = [], [], []
            for text in texts(batch):
                size, parts, floor = _passages(text, model, memo)
                sizes.append(size)
                scores.append(model.probability(model.evidence(parts, max(1, size))))
                found.append([{"start": a, "end": b, "score": s, "log_e": floor - s} for a, b, s in parts if s > floor])
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(scores, pa.float64())],
                names=["doc_id", "n_tokens", "passages", "score"],
            )

    return run


def passage_score(text: Column, model: Model) -> Column:
    """The score of a text, null where it has no significant passage. Only texts go to Python and numbers back."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(scored)(columns)

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Memo(model.scores)
        for column in columns:
            scores = []
            for batch in portions([pa.record_batch([column], names=["text"])]):
                for one in texts(batch):
                    size, parts, floor = _passages(one, model, memo)
                    shown = any(s > floor for _, _, s in parts)
                    scores.append(model.probability(model.evidence(parts, max(1, size))) if shown else None)
            yield pa.array(scores, pa.float64())

    return score(text)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows without a significant passage or with a score below the threshold, all columns kept.

    A score without a passage is the share of toxic labels, which says nothing about the text.
    """
    name = fresh_name(docs, "toxic_score")
    return docs.withColumn(name, passage_score(F.col("text"), model)).where(F.col(name).isNull() | (F.col(name) < threshold)).drop(name)
