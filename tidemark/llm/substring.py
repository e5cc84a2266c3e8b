"""Passages repeated across documents, found by suffix automata over words.

A passage is a window of 13 words; it is removed from a document when the same words
also start in a document of smaller id. An automaton of the whole corpus would grow
with it, so it is not broadcast. The corpus is its own reference and is cut into
shards by content instead: every window belongs to its rarest-looking five words (the
least hash of the nine runs in it), neighbouring windows with the same five words make
a segment, and all segments with those words meet in one shard. The steps:

1. One pass lists the five-word anchors of every text; only those that stand in two
   different texts can hold a repeated window.
2. Segments around these anchors are cut from the texts, equal ones are counted once.
3. A task streams the segments of a shard by document id: each is first run through
   the automaton of the segments before it, whose states know the first document they
   occur in (matching statistics), and is then added to it. An anchor with very many
   segments is cut into single windows, each a shard of its own.
4. Documents get the windows that start in a smaller one back and drop their words.

Equal texts go through this once; all but the first of them are covered completely.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tidemark.llm.common import fresh_name, portions, settle, slices, texts, tidied
from tidemark.llm.jaccard import MIX, WordHash

LEAST_WORDS = 13
ANCHOR_WORDS = 5
SHARD_SEGMENTS = 4096


def text_class(text: Column) -> Column:
    return F.xxhash64(text)


def _segments(words: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each segment and the hash of its anchor."""
    n = len(words) - LEAST_WORDS + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),)
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(len(found) - ANCHOR_WORDS + 1, np.uint64)
    for i in range(ANCHOR_WORDS):
        grams += found[i : len(grams) + i] * MIX[i]
    grams ^= grams >> np.uint64(31)
    grams *= MIX[8]
    grams ^= grams >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(grams, LEAST_WORDS - ANCHOR_WORDS + 1).argmin(1)
    place = least + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, grams[place[first]].view(np.int64)


def _anchors(batches):
    hashes = WordHash()
    for batch in slices(batches):
        anchors = []
        for text in texts(batch):
            anchors.append(np.unique(_segments(text.split(), hashes)[2]))
        lists = pa.array([a.tolist() for a in anchors], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), lists], names=["doc_id", "cls", "anchors"])


def _cut(batches):
    """Segments of the wanted anchors, as their words joined by one space."""
    hashes = WordHash()
    for batch in slices(batches):
        rows = []
        for text, doc_id, cls, wanted in zip(texts(batch), *(batch.column(c).to_pylist() for c in ("doc_id", "cls", "wanted"))):
            words = text.split()
            first, last, anchors = _segments(words, hashes)
            for i in np.flatnonzero(np.isin(anchors, np.array(wanted, np.int64))).tolist():
                start = int(first[i])
                rows.append((int(anchors[i]), b" ".join(words[start : int(last[i]) + LEAST_WORDS]), doc_id, cls, start))
        if rows:
            anchor, segment, doc_id, cls, start = zip(*rows)
            yield pa.record_batch(
                {
                    "shard": pa.array(anchor, pa.int64()), "segment": pa.array(segment, pa.binary()).cast(pa.string()),
                    "doc_id": pa.array(doc_id, pa.int64()), "cls": pa.array(cls, pa.int64()), "start": pa.array(start, pa.int32()),
                }
            )


class Automaton:
    """Suffix automaton of word sequences; each state knows the first document it occurs in."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def _state(self, edges: dict, link: int, size: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, origin: int, word: str, target: int) -> int:
        """A copy of the target for what is reached from the origin and its suffixes."""
        copy = self._state(dict(self.next[target]), self.link[target], self.size[origin] + 1, self.first[target])
        while origin >= 0 and self.next[origin].get(word) == target:
            self.next[origin][word] = copy
            origin = self.link[origin]
        self.link[target] = copy
        return copy

    def add(self, words: list[str], doc_id: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
                continue
            state = self._state({}, 0, self.size[last] + 1, doc_id)
            origin = last
            while origin >= 0 and word not in self.next[origin]:
                self.next[origin][word] = state
                origin = self.link[origin]
            if origin >= 0:
                target = self.next[origin][word]
                self.link[state] = target if self.size[target] == self.size[origin] + 1 else self._split(origin, word, target)
            last = state

    def matches(self, words: list[str], least: int) -> list[int | None]:
        """Per window of ``least`` words the first document that has it, if any.

        Matches longer than a window are cut to it, so the state at hand is that of
        the window's words exactly.
        """
        found: list[int | None] = []
        state = length = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state = length = 0
            if length >= least:
                while self.size[self.link[state]] >= least:
                    state = self.link[state]
                length = least
            if at >= least - 1:
                found.append(self.first[state] if length == least else None)
        return found


def _stream(batches):
    """First documents of every window of every segment, ordered by (shard, doc_id)."""
    shard = automaton = waiting = None
    for batch in batches:
        out = []
        for row_shard, segment, doc_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "doc_id"))):
            words = segment.split(" ")
            if row_shard != shard:
                shard, automaton, waiting = row_shard, None, (words, doc_id)
                out.append([doc_id] * (len(words) - LEAST_WORDS + 1))
                continue
            if waiting:  # a shard's first segment is added once a second one asks for it
                automaton = Automaton()
                automaton.add(*waiting)
                waiting = None
            out.append([doc_id if first is None else first for first in automaton.matches(words, LEAST_WORDS)])
            automaton.add(words, doc_id)
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("segment_key"), pa.array(out, pa.list_(pa.int64()))], names=["shard", "segment_key", "firsts"]
        )


def repeated(docs: DataFrame) -> DataFrame:
    """(cls, least, starts) per text that repeats something.

    ``cls`` is the hash of a text and ``least`` its smallest doc_id; ``starts`` are the
    windows, by their first word, that also start in a document of smaller id, as seen
    from ``least``. Documents of the same text and a larger id repeat it completely.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    docs = docs.withColumn("cls", text_class(F.col("text")))
    listed = settle(docs.mapInArrow(tidied(_anchors), "doc_id long, cls long, anchors array<long>"), "passage-anchors")
    classes = settle(listed.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "passage-texts")
    each = listed.select("cls", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("anchor")
    shared = settle(shared, "passage-shared")
    wanted = each.join(shared, "anchor").distinct().groupBy("cls").agg(F.collect_list("anchor").alias("wanted"))
    wanted = settle(wanted.join(classes, "cls").select(F.col("cls").alias("text_cls"), "least", "wanted"), "passage-wanted")
    heads = docs.join(wanted, (F.col("doc_id") == F.col("least")) & (F.col("cls") == F.col("text_cls")))
    cut = heads.select("text", "doc_id", "cls", "wanted").mapInArrow(tidied(_cut), "shard long, segment string, doc_id long, cls long, start int")
    cut = settle(_spread(settle(cut, "passage-segments")), "passage-spread")
    distinct = cut.groupBy("shard", "segment_key").agg(F.min("doc_id").alias("doc_id"), F.first("segment").alias("segment"))
    ordered = distinct.repartition("shard").sortWithinPartitions("shard", "doc_id", "segment_key")
    firsts = settle(ordered.mapInArrow(tidied(_stream), "shard long, segment_key long, firsts array<long>"), "passage-firsts")
    windows = (
        cut.select("shard", "segment_key", "doc_id", "cls", "start").join(firsts, ["shard", "segment_key"])
        .select("cls", "doc_id", "start", F.posexplode("firsts").alias("place", "first")).where("first < doc_id")
        .groupBy("cls").agg(F.sort_array(F.collect_set(F.col("start") + F.col("place"))).alias("starts"))
    )
    return settle(classes.join(windows, "cls", "left").where("copies > 1 or starts is not null").select("cls", "least", "starts"), "passage-starts")


def _spread(cut: DataFrame) -> DataFrame:
    """Segments with their keys; those of crowded anchors as single windows, each its own shard."""
    keyed = cut.withColumn("segment_key", F.xxhash64(F.lit(1), "segment"))
    distinct = keyed.select("shard", "segment_key").distinct()  # copies of a passage inside it are one segment
    crowded = distinct.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_SEGMENTS)
    crowded = settle(crowded.select("shard"), "passage-crowded")
    words = F.split("segment", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - LEAST_WORDS + 1), lambda i: F.array_join(F.slice("words", i, LEAST_WORDS), " "))
    single = (
        keyed.join(crowded, "shard", "left_semi").withColumn("words", words)
        .select("doc_id", "cls", "start", F.posexplode(windows).alias("place", "segment"))
        .select(F.xxhash64(F.lit(2), "segment").alias("shard"), "segment", "doc_id", "cls", (F.col("start") + F.col("place")).alias("start"))
        .withColumn("segment_key", F.xxhash64(F.lit(1), "segment"))
    )
    return keyed.join(crowded, "shard", "left_anti").unionByName(single)


def spans(starts: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by the windows, as (start, end), end exclusive."""
    covered = np.zeros(n_words + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + LEAST_WORDS, -1)
    inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


REMOVED = StructType().add("n_words", IntegerType()).add(
    "spans", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))
).add("kept", StringType()).add("kept_sha256", StringType())


def _remove(with_text: bool):
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, doc_id, least, starts in zip(texts(batch), *(batch.column(c).to_pylist() for c in ("id", "least", "starts"))):
                words = text.split()
                n = len(words)
                if least is not None and doc_id is not None and doc_id > least:
                    gone = [(0, n)] if n >= LEAST_WORDS else []
                else:
                    gone = spans(np.array(starts, np.int64), n) if starts else []
                kept, at = [], 0
                for start, end in [*gone, (n, n)]:
                    kept += words[at:start]
                    at = end
                kept = b" ".join(kept)
                out.append((n, [{"start": a, "end": b} for a, b in gone], kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
            n, gone, kept, digest = zip(*out) if out else ((), (), (), ())
            added = [pa.array(n, pa.int32()), pa.array(gone, struct), pa.array(kept, pa.string()), pa.array(digest, pa.string())]
            kept_columns = [(c, batch.column(c)) for c in batch.schema.names if c not in ("id", "least", "starts")]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept_columns), *added], names=[*(c for c, _ in kept_columns), *REMOVED.names])

    return run


def remove_repeated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of (doc_id, text): n_words, removed spans of words, kept text and its SHA-256.

    Words stand between ASCII white space; kept ones are joined by one space. Null and
    empty texts have no word. Rows without doc_id are neither searched nor a reference.
    Repeated rows get the same result; no row is a reference for another of its id.
    ``kept`` is null without ``with_text``.
    """
    found = repeated(docs)
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("id"), text_class(F.col("text")).alias("cls"))
    joined = rows.join(found, "cls", "left").select("doc_id", "text", "id", "least", "starts")
    schema = StructType([*docs.select("doc_id", "text").schema.fields, *REMOVED.fields])
    return joined.mapInArrow(tidied(_remove(with_text)), schema).drop("text")


def strip_repeated(docs: DataFrame) -> DataFrame:
    """All columns; texts that repeat something keep their other words, others stay as they are.

    Rows of which nothing is left go.
    """
    found = repeated(docs)
    id_name, cls_name = fresh_name(docs, "passage_id"), fresh_name(docs, "passage_cls")
    marked = docs.withColumns({id_name: F.col("doc_id").cast("long"), cls_name: text_class(F.col("text"))})
    found = found.toDF(*(fresh_name(marked, f"passage_{c}") for c in ("text_cls", "least", "starts")))
    joined = marked.join(found, F.col(cls_name) == F.col(found.columns[0]), "left")
    name = fresh_name(docs, "passage_kept")
    columns, inputs = docs.columns, [id_name, *found.columns[1:]]

    def run(batches):
        work = _remove(True)
        for batch in portions(batches):  # what was made of a portion goes out before the next is read
            inner = pa.RecordBatch.from_arrays(
                [batch.column("text"), *(batch.column(c) for c in inputs)], names=["text", "id", "least", "starts"]
            )
            for done, part in zip(work([inner]), slices([batch])):
                changed = [k if s else t for t, k, s in zip(part.column("text").to_pylist(), done.column("kept").to_pylist(), done.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(changed, pa.string())], names=[*columns, name])

    schema = StructType([*docs.schema.fields]).add(name, StringType())
    stripped = joined.mapInArrow(tidied(run), schema)
    gone = (F.col(name) == "") & (F.col("text") != "")
    return stripped.where(~F.coalesce(gone, F.lit(False))).withColumn("text", F.col(name)).drop(name)
