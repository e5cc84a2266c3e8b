"""Log-probabilities of texts: a word unigram base and prediction by partial matching.

The byte model is a trie of contexts of up to four bytes, counted over all training
texts. A symbol that a context has not seen costs an escape (as many as the context has
distinct symbols, out of all it has seen) and is then predicted by the context without
its first byte, where the symbols of the longer context are excluded; last comes an even
choice among the bytes that no text had. Texts begin behind zero bytes.

All counts are kept, in a written table that grows with the corpus. Contexts of up to
two bytes go to every task, since there are at most 2**24 sequences of three bytes. Those
of three and four bytes are dealt by their last three, so that a task holds all that a
price asks for, a part of the contexts at a time. Of the prices made there, those of
sequences that make up at least 1 of 2**21 of the training bytes (at most 2**21) go to
every task to save work; all others that a text has, unseen ones too, are priced once
each and looked up by a join. Words are treated alike: those that make up 1 of 2**20 of
all tokens go to every task, all rarer ones are looked up by a join, in which no key is
frequent.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowered_words, settle, slices, texts

ORDER = 4
SHORT = 2  # context bytes of the longest sequences that every task gets all of
GRAM_SHARE = 1 << 21
WORD_SHARE = 1 << 20
PRICED_ROWS = 500_000  # sequences of whole contexts that a task prices at a time
PENDING_GRAMS = 1_500_000
PENDING_WORDS = 400_000
END = b""  # the token behind a text's last word; no word is empty


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with those before it as one number, and where each text begins."""
    sizes = np.array([len(t) for t in found], np.int64)
    starts = np.cumsum(sizes) - sizes
    if not sizes.sum():
        return np.empty(0, np.uint64), starts
    padded = np.frombuffer(b"".join(b"\0" * ORDER + t for t in found), np.uint8).astype(np.uint64)
    joined = padded[ORDER:].copy()
    for back in range(1, ORDER + 1):
        joined |= padded[ORDER - back : -back] << np.uint64(8 * back)
    inside = np.ones(len(joined), bool)  # places between two texts end in zero bytes of the next one
    for back in range(ORDER):
        inside[(starts[1:] + ORDER * np.arange(1, len(found)) - ORDER + back)] = False
    return joined[inside], starts


def _low(keys: np.ndarray, size: int) -> np.ndarray:
    """The last bytes of sequences."""
    return keys & np.uint64((1 << 8 * size) - 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(p) for p in zip(*parts))
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _count(batches):
    """Words and byte sequences of one task with their counts."""
    words, parts, pending = Counter(), [], 0

    def word_rows():
        names = list(words)
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            yield _rows(pa.array(part, pa.binary()), None, pa.array([words[w] for w in part], pa.int64()))
        words.clear()

    for batch in slices(batches):
        found = texts(batch)
        for text in found:
            words.update(lowered_words(text))
        words[END] += len(found)
        parts.append(np.unique(grams(found)[0], return_counts=True))
        pending += len(parts[-1][0])
        if pending > PENDING_GRAMS:
            parts = [_merge(parts)]
            pending = 0
        if len(words) > PENDING_WORDS:
            yield from word_rows()
    if parts:
        keys, counts = _merge(parts)
        for at in range(0, len(keys), 100_000):
            yield _rows(None, pa.array(keys[at : at + 100_000].astype(np.int64)), pa.array(counts[at : at + 100_000]))
        yield from word_rows()


def _rows(words, keys, n) -> pa.RecordBatch:
    nothing = lambda kind: pa.nulls(len(n), kind)
    return pa.record_batch({"word": nothing(pa.binary()) if words is None else words, "gram": nothing(pa.int64()) if keys is None else keys, "n": n})


class Trie:
    """Log10 probability of each byte after those before it."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], shorter: Trie | None = None):
        """``counts[k]``: sorted sequences of k context bytes and a symbol, with counts.

        With a shorter trie, its orders come first and are taken as they are.
        """
        self.counts = [*shorter.counts] if shorter else []
        self.contexts = [*shorter.contexts] if shorter else []  # per order: keys, sum and number of symbols, and both of the next shorter context without these symbols
        for keys, n in counts:
            order = len(self.counts)
            self.counts.append((keys, n))
            context, start = np.unique(keys >> np.uint64(8), return_index=True)
            if not len(keys):
                self.contexts.append((context, *(np.empty(0),) * 4))
                continue
            total = np.add.reduceat(n, start).astype(float)
            kinds = np.diff(np.append(start, len(keys))).astype(float)
            if order:
                lower = self._count(order - 1, _low(keys, order))
                base = self._context(order - 1, _low(context, order - 1))
                rest = (base[1] - np.add.reduceat(lower, start), base[2] - kinds)
            else:
                rest = (np.zeros(len(context)), 256 - kinds)
            self.contexts.append((context, total, kinds, *rest))

    def _find(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def _count(self, order: int, wanted: np.ndarray) -> np.ndarray:
        keys, n = self.counts[order]
        at, known = self._find(keys, wanted)
        return np.where(known, n[at], 0) if len(keys) else np.zeros(len(wanted))

    def _context(self, order: int, wanted: np.ndarray):
        context, total, kinds, rest, rest_kinds = self.contexts[order]
        at, known = self._find(context, wanted)
        if not len(context):
            return (known, *(np.zeros(len(wanted)),) * 4)
        return known, *(np.where(known, c[at], 0.0) for c in (total, kinds, rest, rest_kinds))

    def cost(self, wanted: np.ndarray) -> np.ndarray:
        """Log10 probabilities, from the longest context down."""
        out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
        total = kinds = None
        arrived = np.zeros(len(wanted), bool)  # by escape, so that sum and number exclude the longer context's symbols
        excluded = (np.zeros(len(wanted)), np.zeros(len(wanted)))
        for order in range(ORDER, -1, -1):
            known, total, kinds, rest, rest_kinds = self._context(order, _low(wanted >> np.uint64(8), order))
            total, kinds = np.where(arrived, excluded[0], total), np.where(arrived, excluded[1], kinds)
            n = self._count(order, _low(wanted, order + 1))
            hit = open_ & known & (n > 0)
            out[hit] += np.log10(n[hit] / (total[hit] + kinds[hit]))
            open_ &= ~hit
            escape = open_ & known & (kinds > 0)
            out[escape] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            arrived = known
            excluded = (rest, rest_kinds)
        out[open_] -= np.log10(np.where(arrived, excluded[1], 256.0)[open_])
        return out


class Prices:
    """Costs of the most frequent sequences, in an open table, so that most bytes take one look."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.keys, self.costs = keys, costs
        self.slots = None  # made by each task, so that it does not travel

    def _index(self) -> None:
        keys = self.keys
        self.bits = max(10, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = keys[free].astype(np.int64)
            placed = self.slots[slot[left]] == keys[left].astype(np.int64)
            self.values[slot[left[placed]]] = self.costs[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, found: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Log10 probability of each text without the sequences that are not here.

        These follow as (place of the text, sequence, times), by text.
        """
        if self.slots is None:
            self._index()
        keys, starts = grams(found)
        slot = self._slot(keys)
        out = self.values[slot]
        signed = keys.view(np.int64)
        left, absent = np.flatnonzero(self.slots[slot] != signed), []
        while len(left):
            missing = self.slots[slot[left]] < 0
            out[left[missing]] = 0.0
            absent.append(left[missing])
            left = left[~missing]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            same = self.slots[slot[left]] == signed[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same]
        sums = np.concatenate([[0.0], np.cumsum(out)])
        at = np.concatenate([np.empty(0, np.int64), *absent])
        place = np.repeat(np.arange(len(found)), np.diff(np.append(starts, len(keys))))
        shift = np.uint64(8 * (ORDER + 1))
        pairs, times = np.unique(place[at].astype(np.uint64) << shift | keys[at], return_counts=True)
        return sums[np.append(starts[1:], len(keys))] - sums[starts], (pairs >> shift, _low(pairs, ORDER + 1), times)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, n, len(unique))


def _priced(rows: DataFrame, shorter: Trie) -> DataFrame:
    """(gram, cost) of the rows of (gram, n, asked) that are asked for.

    Rows with n above zero are the counts, each sequence once; a row without only asks.
    All rows of a context of three bytes meet in a task, at most 2**17 of them.
    """

    def price(parts):
        grams_, n, asked = (np.concatenate(p) for p in zip(*parts))
        grams_, wanted = grams_.astype(np.uint64), np.unique(grams_[asked].astype(np.uint64))
        longest = _sums(grams_[n > 0], n[n > 0])
        middle = _sums(_low(longest[0], ORDER), longest[1])
        costs = Trie([middle, longest], shorter).cost(wanted)
        return pa.record_batch({"gram": pa.array(wanted.astype(np.int64)), "cost": pa.array(costs)})

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            part = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n", "asked"))
            context = batch.column("context").to_numpy()
            if not len(context):
                continue
            if held > PRICED_ROWS:  # cut where a context ends; the first rows may belong to the last one
                first = 0 if context[0] != last else int(np.append(np.flatnonzero(context != last), len(context))[0])
                parts.append(tuple(c[:first] for c in part))
                if first < len(context):
                    yield price(parts)
                    parts, held = [], 0
                part = tuple(c[first:] for c in part)
            parts.append(part)
            held, last = held + len(part[0]), context[-1]
        if held:
            yield price(parts)

    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1).cast("long"))
    dealt = rows.select(context.alias("context"), "gram", "n", "asked").repartition("context").sortWithinPartitions("context")
    return dealt.mapInArrow(run, "gram long, cost double")


@dataclass(frozen=True)
class Model:
    vocabulary: DataFrame  # (word, n) of all training tokens
    tokens: int
    kinds: int
    frequent: dict[bytes, int]
    sequences: DataFrame  # (gram, n) of all training bytes
    shorter: Trie
    prices: Prices


def fit(docs: DataFrame) -> Model:
    """Count words, with an end token per text, and byte sequences of all training texts.

    Null texts are empty. Without any text the base has no token and the bytes are even.
    """
    counted = docs.select("text").mapInArrow(_count, "word binary, gram long, n long")
    counted = settle(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")), "ppm-counts")
    words = counted.where("word is not null").select("word", "n")
    sums = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = int(sums["tokens"] or 0), int(sums["kinds"])
    common = words.where(F.col("n") >= tokens / WORD_SHARE).toArrow()
    frequent = dict(zip(common.column("word").to_pylist(), common.column("n").to_pylist()))
    sequences = counted.where("gram is not null").select("gram", "n")
    size = int(sequences.agg(F.sum("n")).first()[0] or 0)
    counts = []
    for order in range(SHORT + 1):
        mask = (1 << 8 * (order + 1)) - 1
        level = sequences.groupBy(F.col("gram").bitwiseAND(F.lit(mask).cast("long")).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        keys, n = level.column("gram").to_numpy().astype(np.uint64), level.column("n").to_numpy().astype(float)
        place = np.argsort(keys, kind="stable")
        counts.append((keys[place], n[place]))
    shorter = Trie(counts)
    frequent_grams = _priced(sequences.withColumn("asked", F.col("n") >= size / GRAM_SHARE), shorter).toArrow()
    prices = Prices(frequent_grams.column("gram").to_numpy().astype(np.uint64), frequent_grams.column("cost").to_numpy())
    return Model(words, tokens, kinds, frequent, sequences, shorter, prices)


SCORED = "doc_id long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,times:long>>, unpriced array<struct<gram:long,times:long>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, n_known, base_score and the model's score, log10.

    Null and empty texts are the end token alone and score 0 in the byte model. Repeated
    rows score alike; other columns are not read.
    """
    tokens, kinds, frequent, prices = model.tokens, model.kinds, model.frequent, model.prices
    norm = math.log10(max(0.5, tokens + 0.5 * (kinds + 1)))
    logs = {w: math.log10(n + 0.5) - norm for w, n in frequent.items()}
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            found = texts(batch)
            sizes, known, base, rare = [], [], [], []
            for text in found:
                words = Counter(lowered_words(text))
                words[END] = 1
                sizes.append(words.total())
                hits = logs.keys() & words.keys()
                known.append(sum(words[w] for w in hits))
                base.append(math.fsum(words[w] * logs[w] for w in hits))
                rare.append([{"word": w, "times": n} for w, n in words.items() if w not in logs])
            scores, (place, keys, times) = prices.score(found)
            ends = np.searchsorted(place, np.arange(len(found) + 1, dtype=np.uint64)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], names=["gram", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, rare_type), pa.ListArray.from_arrays(pa.array(ends), pairs)],
                names=["doc_id", "n_tokens", "known", "base", "score", "rare", "unpriced"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id())
    scored = settle(scored, "ppm-scored")  # numbers of rows hold from here on
    each = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    n = F.coalesce(F.col("n"), F.lit(0))
    looked = (
        each.join(model.vocabulary.where(F.col("n") < tokens / WORD_SHARE), "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * (F.log10(n + 0.5) - norm)).alias("rare_base"),
        )
    )
    held = scored.select("row", F.explode("unpriced").alias("u")).select("row", "u.gram", "u.times")
    asked = held.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    costs = settle(_priced(model.sequences.withColumn("asked", F.lit(False)).unionByName(asked), model.shorter), "ppm-costs")
    added = held.join(costs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("added"))
    return scored.drop("rare", "unpriced").join(looked, "row", "left").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + _or_zero("rare_known")).alias("n_known"),
        (F.col("base") + _or_zero("rare_base")).alias("base_score"), (F.col("score") + _or_zero("added")).alias("score"),
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))
