"""Encoding and decoding with a piece vocabulary by a streaming Viterbi search.

A text becomes a space mark, then itself with spaces as marks. Of all ways to cut it
into pieces of the vocabulary, the one with the highest sum of piece scores is taken
(on equal sums the one whose last piece begins earlier). Characters without a piece,
among them the mark itself if a text has it, cost more than any piece and are spelled
in byte pieces, so decoding gives back the text exactly.

The search reads characters one by one. It keeps the nodes that a piece in progress may
still start from, which are as many as the longest piece has characters, and what lies
between them and the last boundary that all their paths go through; as soon as the paths
converge on a later boundary, the ids before it are committed. Words that were met before
take their ids from memory, since in the vocabularies used no piece runs on into a mark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import MemoIds, slices

MARK = "▁"
UNFIT = "\ud800"  # stands for a mark that is part of a text; texts have no surrogates
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LONGEST_WORD = 64  # longer ones are streamed without being remembered
RESERVE = 10  # what an unknown character costs beyond the lowest score


class Pieces:
    """A vocabulary as a tree of characters: node -> {character: node}, with id and score."""

    def __init__(self, pieces: Iterable[tuple[str, int, float]], byte_ids: dict[int, int]):
        self.children: list[dict[str, int]] = [{}]
        self.ids: list[int] = [-1]
        self.scores: list[float] = [0.0]
        self.text: dict[int, bytes] = {i: bytes([b]) for b, i in byte_ids.items()}
        self.byte_ids, self.longest, lowest, self.crosses = byte_ids, 1, 0.0, False
        for piece, number, score in pieces:
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ids.append(-1)
                    self.scores.append(0.0)
                node = self.children[node][c]
            self.ids[node], self.scores[node] = number, score
            self.text[number] = piece.replace(MARK, " ").encode()
            self.longest = max(self.longest, len(piece))
            self.crosses |= re.search(f"[^{MARK}]{MARK}", piece) is not None
            lowest = min(lowest, score)
        self.unknown = lowest - RESERVE
        # The same tree with what a step finds in one place: character -> (its steps, id, score).
        steps: list[dict] = [{} for _ in self.children]
        for node, follow in enumerate(self.children):
            steps[node].update((c, (steps[to], self.ids[to], self.scores[to])) for c, to in follow.items())
        self.steps = steps[0]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in known if model.is_byte(i)}
        normal = [i for i in known if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls(((model.id_to_piece(i), i, model.get_score(i)) for i in normal), byte_ids)

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """Ids of the best cut, each as soon as it is certain."""
        children, ids, scores = self.children, self.ids, self.scores
        best: dict[int, float] = {0: 0.0}  # by boundary
        back: dict[int, tuple[int, int | str]] = {}  # where its last piece starts, and its id or its unknown character
        walks: list[tuple[int, int]] = []  # pieces in progress: start, node
        at = done = 0
        for c in characters:
            walks.append((at, 0))
            at += 1
            going, top, last = [], None, None
            for start, node in walks:
                if (node := children[node].get(c)) is None:
                    continue
                if children[node]:
                    going.append((start, node))
                if ids[node] >= 0 and (top is None or best[start] + scores[node] > top):
                    top, last = best[start] + scores[node], (start, ids[node])
            lone = children[0].get(c)
            if lone is None or ids[lone] < 0:
                value = best[at - 1] + self.unknown
                if top is None or value > top:
                    top, last = value, (at - 1, c)
            best[at], back[at], walks = top, last, going
            if walks and at - done < self.longest:
                continue  # too few characters to be worth a look
            live = {at, *(start for start, _ in walks)}
            while len(live) > 1:  # the latest steps back until all stand on one boundary
                latest = max(live)
                live.remove(latest)
                live.add(back[latest][0] if latest > done else done)
            if (common := live.pop()) > done:
                yield from self._commit(back, done, common)
                for gone in range(done, common):
                    best.pop(gone, None)
                    back.pop(gone + 1, None)
                done = common
        yield from self._commit(back, done, at)

    def cut(self, word: str) -> list[int]:
        """Ids of the best cut of a short text, as ``stream`` finds them: starts are taken in order."""
        first, unknown, n = self.steps, self.unknown, len(word)
        best, back = [-inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            so_far, steps, end = best[start], first, start
            for c in word[start:]:
                if (step := steps.get(c)) is None:
                    break
                steps, number, score = step
                end += 1
                if number >= 0 and so_far + score > best[end]:
                    best[end], back[end] = so_far + score, (start, number)
            c = word[start]
            lone = first.get(c)
            if (lone is None or lone[1] < 0) and so_far + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = so_far + unknown, (start, c)
        return self._commit(back, 0, n)

    def _commit(self, back: dict | list, start: int, end: int) -> list[int]:
        parts = []
        while end > start:
            end, part = back[end]
            parts.append(part)
        out: list[int] = []
        for part in reversed(parts):
            out += [part] if isinstance(part, int) else [self.byte_ids[b] for b in (MARK if part == UNFIT else part).encode()]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))[1:]


def marked(text: str) -> str:
    """The text as the search reads it."""
    return MARK + text.replace(MARK, UNFIT).replace(" ", MARK)


class Encoder(MemoIds):
    """Ids of texts; each distinct word is searched once."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.vocabulary = pieces

    def ids_of(self, word: str) -> list[int]:
        return self.vocabulary.cut(word)

    def encode(self, text: str) -> np.ndarray:
        text = marked(text)
        if self.vocabulary.crosses:
            return np.fromiter(self.vocabulary.stream(text), np.uint32)
        parts, words, found = [], [], WORDS.findall(text)
        if max(map(len, found)) <= LONGEST_WORD:
            return self.gather(found)
        for word in found:
            if len(word) <= LONGEST_WORD:
                words.append(word)
                continue
            parts += [self.gather(words), np.fromiter(self.vocabulary.stream(word), np.uint32)]
            words = []
        return np.concatenate([*parts, self.gather(words)])


ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, text) its ids. Null and empty texts are the one space mark.

    Repeated rows are encoded alike; other columns are not read.
    """

    def run(batches):
        encoder = Encoder(Pieces.load(model))
        for batch in slices(batches, 64):
            found = [encoder.encode(t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""

    def run(batches):
        pieces = Pieces.load(model)
        for batch in slices(batches, 64):
            found = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, text) the number and CRC-32 of its ids (little-endian, four bytes
    each) and whether decoding them gives the text back; null texts count as empty."""

    def run(batches):
        encoder = Encoder(Pieces.load(model))
        for batch in slices(batches, 64):
            plain = [t or "" for t in batch.column("text").to_pylist()]
            found = [encoder.encode(t) for t in plain]
            columns = [
                batch.column("doc_id").cast(pa.int64()), pa.array(map(len, found), pa.int64()),
                pa.array((zlib.crc32(ids.astype("<u4").tobytes()) for ids in found), pa.int64()),
                pa.array((encoder.vocabulary.decode(ids.tolist()) == t.encode() for ids, t in zip(found, plain)), pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
