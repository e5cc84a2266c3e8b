"""Training sequences by vector bin packing.

Examples are cut into pieces of at most one sequence. Pieces are dealt by hash into
cells of bounded size, and a task packs each cell: a sequence opens with the largest
piece left and takes, as long as one fits, the piece whose (tokens, segments,
loss-bearing tokens) has the highest dot product with what the sequence has left of
its limits. Cells are independent, so a lost task repeats one cell; each leaves one
badly filled sequence at most.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.llm.common import MemoIds, fresh_name, portions, texts, tidied

CELL_PIECES = 4096
END = 2
WORDS_BYTES = 1 << 18  # bytes of texts whose words are looked up at once


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096


# The pieces the tokenizer cuts a lower-case word into before it merges bytes,
# for words of printable ASCII and accented Latin letters, whose lower case and normal form
# are single characters.
PLAIN = re.compile("[\\x21-\\x7e\u00c0-\u012f\u0131-\u017f]*")
CUTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+|\n"
)
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves


def _byte_names() -> dict[int, str]:
    """The character that the vocabulary has for each byte: itself, or one above 255."""
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    return {**{b: chr(b) for b in VISIBLE}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Merges(MemoIds):
    """Ids of the pieces of words, each distinct piece merged once."""

    most = 300_000

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.names = tokenizer.model, _byte_names()

    def ids_of(self, piece: str) -> list[int]:
        if piece == "\n":  # the end of a word
            return []
        named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return [token.id for token in self.model.tokenize(named)]


class Encoder(MemoIds):
    """Ids of texts, each distinct word between ASCII white space encoded once.

    The tokenizer drops white space and looks at no context beyond it. Plain words are
    cut here, many at once, and only their pieces go through the tokenizer's merges;
    others take its whole way.
    """

    most = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)

    def ids_of(self, word: bytes) -> list[int]:
        return self._made([word])[0].tolist()

    def _made(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        decoded = b"\n".join(words).decode("utf-8", "replace").split("\n")
        marked = ["<|" not in w and PLAIN.fullmatch(w) is not None for w in decoded]
        plain = decoded if all(marked) else [w for w, is_plain in zip(decoded, marked) if is_plain]
        pieces = CUTS.findall("\n".join([*plain, ""]).lower())
        ids, sizes = self.merges.gather_sized(pieces)
        ends = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        last = np.cumsum(sizes)[ends]
        sizes = np.diff(last, prepend=0)
        if len(plain) == len(words):
            return ids, sizes
        parts, found = np.split(ids, last), iter(range(len(plain)))
        parts = [
            parts[next(found)] if is_plain else np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            for w, is_plain in zip(decoded, marked)
        ]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, text: bytes) -> np.ndarray:
        return self.gather(self._words(text))

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text, the words of all looked up at once."""
        words, ends = [], []
        for text in texts:
            words += self._words(text)
            ends.append(len(words))
        ids, sizes = self.gather_sized(words)
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[[0, *ends]]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, longest: int = 4096) -> DataFrame:
    """Pieces of every row of (doc_id, text), each id followed by an end id in exactly one.

    Null and empty texts are one piece that holds the end id only. Repeated rows and
    null ids are packed like any other row.
    """

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in portions(batches, WORDS_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts(batch))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                rows += [
                    (doc_id, at, len(part := ids[at : at + longest]), zlib.crc32(part.tobytes()), len(ids))
                    for at in range(0, len(ids), longest)
                ]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), PIECES)


def fill(sizes: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a cell.

    Pieces of equal size and loss are alike, so the choice is among kinds. A piece
    beyond a limit of its own gets a sequence alone.
    """
    kinds, kind_of = np.unique(np.stack([sizes, loss], 1), axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    by_kind = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    next_of = np.cumsum(left) - left
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    needs = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], 1).astype(float)
    shares = needs / most
    order = np.argsort(-shares.max(1), kind="stable")
    kinds, needs, shares, left, next_of = kinds[order], needs[order], shares[order], left[order], next_of[order]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    current, remaining = 0, len(sizes)
    while remaining:
        room, at, pick = most.copy(), 0, int(np.argmax(left > 0))
        while pick >= 0:
            piece = by_kind[next_of[pick]]
            bins[piece], offsets[piece] = current, at
            next_of[pick] += 1
            left[pick] -= 1
            remaining -= 1
            at += int(kinds[pick, 0])
            room -= needs[pick]
            fits = np.flatnonzero((left > 0) & (needs <= room).all(1))
            pick = int(fits[np.argmax(shares[fits] @ (room / most))]) if len(fits) else -1
        current += 1
        if current % 64 == 0:  # forget kinds that ran out
            keep = left > 0
            kinds, needs, shares, left, next_of = kinds[keep], needs[keep], shares[keep], left[keep], next_of[keep]
    return bins, offsets


def pack(items: DataFrame, n_items: int, key: Column, tokens: str, loss: Column, limits: Limits = Limits()) -> DataFrame:
    """Items with the columns sequence_id and offset added; all others are kept.

    ``key`` deals rows into cells; ``tokens`` names the column of sizes, ``loss``
    counts loss-bearing tokens (nulls count as none). Of items alike in size and loss, and of
    equally good kinds, the first in order is taken. No items, no sequences.
    """
    cells = max(1, -(-n_items // CELL_PIECES))
    names, cell_name, loss_name = [*items.columns], fresh_name(items, "cell"), fresh_name(items, "loss_tokens")
    dealt = items.withColumns(
        {cell_name: F.pmod(F.xxhash64(key), F.lit(cells)), loss_name: F.coalesce(loss.cast("long"), F.lit(0).cast("long"))}
    )
    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (tokens, *(n for n in names if n != tokens))])
        sizes = table.column(tokens).fill_null(0).to_numpy()
        bins, offsets = fill(sizes, table.column(loss_name).to_numpy(), limits)
        cell = table.column(cell_name)[0].as_py()
        kept = table.select(names)
        return kept.append_column("sequence_id", pa.array(bins + (cell << 32))).append_column("offset", pa.array(offsets))

    return dealt.groupBy(cell_name).applyInArrow(run, schema)
