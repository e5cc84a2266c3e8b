"""Cheapest repair of the structure of conversations by square-root checkpointed DP.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Keeping a turn
costs nothing, giving it another role 1, deleting it 2, inserting an empty turn 5, and a
truncated turn that stays 5. Blank and repeated turns must go. A state is what the turns
emitted so far end with; the backward cost of a state is what the rest of the
conversation costs from there.

A first pass streams each conversation backwards, carries the cost vector of the four
states and stores it only at checkpoints, at growing distances from the end, so n turns
have some sqrt(n) checkpoints. A second pass streams turns and checkpoints forwards: it
holds one block of some sqrt(n) turns, recomputes its vectors from the next checkpoint,
and walks through them, taking of all edits that keep the cost least (tight edits) the one
whose initial is first in ASCII. Both passes are sorted streams: a conversation of any
length takes one block of memory, and turns are ordered by Spark's sort, which spills.
The first pass carries hashes of the texts only. The result's digest of a whole repaired
conversation is one sequential hash, so a conversation is one stream.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.llm.common import portions

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what was emitted last
NEXT = (USER, USER, ASSISTANT, USER)  # after a turn that is reroled or inserted
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)
BLOCK = 16  # checkpoints lie BLOCK * m * m turns from the end
FINE, CUT, GONE = range(3)  # a turn may stay, may stay as a truncated one, must go
HEAD = 32  # characters of a text that order turns of one turn number and role

Vector = tuple[int, int, int, int]


def before(costs: Vector, initial: str, state: int) -> Vector:
    """Backward costs in front of a turn from those behind it."""
    own = [DELETE + c for c in costs]
    if state != GONE:
        stays = TRUNCATED if state == CUT else 0
        for at in range(4):
            own[at] = min(own[at], REROLE + stays + costs[NEXT[at]])
            if (to := KEPT[at].get(initial)) is not None:
                own[at] = min(own[at], KEEP + stays + costs[to])
    user = min(own[USER], INSERT + own[ASSISTANT])
    return min(own[NOTHING], INSERT + user), min(own[SYSTEM], INSERT + user), user, min(own[ASSISTANT], INSERT + own[USER])


def tight(at: int, here: Vector, behind: Vector, initial: str, state: int) -> tuple[str, int]:
    """The ASCII-least edit that keeps the cost least, and the state after it."""
    cost, stays = here[at], TRUNCATED if state == CUT else 0
    if DELETE + behind[at] == cost:
        return "D", at
    if INSERT + here[NEXT[at]] == cost:
        return "I", NEXT[at]
    if (to := KEPT[at].get(initial)) is not None and stays + behind[to] == cost:
        return "K", to
    return "R", NEXT[at]


# -- both passes as sorted streams ----------------------------------------------------

ORDER = ["turn", "role", "head", "h1", "h2"]


def _prepared(turns: DataFrame) -> DataFrame:
    """conv_id, the order of turns, text, whether it is blank or truncated; null roles and texts are one space."""
    text = F.coalesce("text", F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )


def _streamed(rows: DataFrame, backwards: bool) -> DataFrame:
    """Rows of a conversation in one partition and in order, repeated ones marked.

    All windows and sorts work on the one partitioning by conversation.
    """
    first = Window.partitionBy("conv_id", "kind", "role", "h1", "h2").orderBy(F.asc_nulls_first("turn"))
    marked = rows.repartition("conv_id").withColumn("again", F.row_number().over(first) > 1)
    way = F.desc_nulls_last if backwards else F.asc_nulls_first
    return marked.sortWithinPartitions(way("conv_id"), *(way(c) for c in (*ORDER, "kind", "block", "again")))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in portions(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _state(blank: bool, again: bool, cut: bool) -> int:
    return GONE if blank or again else CUT if cut else FINE


def checkpoints(rows: DataFrame) -> DataFrame:
    """The first pass: per block, the place of its first turn, its turns, and the costs behind it.

    Blocks that begin with rows alike share that place; ``block`` has them in order.
    """
    slim = rows.drop("text").withColumns({"kind": F.lit(1), "block": F.lit(0)})
    schema = StructType([slim.schema[c] for c in ("conv_id", *ORDER)]).add("block", "integer").add("n", "long")
    for name in ("nothing", "system", "user", "assistant"):
        schema = schema.add(name, "long")
    kinds = slim.limit(0).toArrow().schema  # Arrow types of the keys

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, n, held, block, costs, start = None, 0, 0, 0, AT_END, AT_END

        def block_done() -> None:
            out.append((*key, -block, n - held, *start))

        def flush() -> pa.RecordBatch:
            types = [kinds.field(c).type for c in ("conv_id", *ORDER)] + [pa.int32()] + [pa.int64()] * 5
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
            out.clear()
            return done

        key = None
        for conv_id, turn, role, head, h1, h2, blank, cut, _, _, again in _rows(batches):
            if key is not None and conv_id != current:
                if n > held:
                    block_done()
                key = None
            if key is None:
                current, n, held, block, costs, start = conv_id, 0, 0, 0, AT_END, AT_END
            costs = before(costs, role[:1], _state(blank, again, cut))
            key, n = (conv_id, turn, role, head, h1, h2), n + 1
            if n == BLOCK * (block + 1) ** 2:
                block_done()
                held, block, start = n, block + 1, costs
            if len(out) >= 10_000:
                yield flush()
        if key is not None and n > held:
            block_done()
        if out:
            yield flush()

    names = ["conv_id", *ORDER, "blank", "cut", "kind", "block"]
    return _streamed(slim.select(names), backwards=True).mapInArrow(run, schema)


class Walk:
    """One conversation of the second pass: takes checkpoints and turns, hands every edit to a sink."""

    def __init__(self, sink: Callable[[str, int | None, str, str], None]):
        self.sink, self.at, self.cost = sink, NOTHING, None
        self.blocks: deque[tuple[int, Vector]] = deque()
        self.held: list[tuple] = []

    def checkpoint(self, n: int, costs: Vector) -> None:
        self.blocks.append((n, costs))

    def turn(self, turn: int | None, role: str, text: str, state: int) -> None:
        self.held.append((turn, role, text, state))
        if len(self.held) == self.blocks[0][0]:
            self._block(self.blocks.popleft()[1])

    def _block(self, behind: Vector) -> None:
        vectors = [behind]
        for _, role, _, state in reversed(self.held):
            vectors.append(before(vectors[-1], role[:1], state))
        if self.cost is None:
            self.cost = vectors[-1][NOTHING]
        for (turn, role, text, state), behind in zip(self.held, reversed(vectors[:-1])):
            here = vectors.pop()
            while True:
                edit, to = tight(self.at, here, behind, role[:1], state)
                if edit == "D":
                    self.sink("D", turn, role, text)
                elif edit == "I":
                    self.sink("I", None, NAMES[to], "")
                else:
                    self.sink(edit, turn, role if edit == "K" else NAMES[to], text)
                self.at = to
                if edit != "I":
                    break
        self.held.clear()

    def end(self) -> None:
        while AT_END[self.at]:
            self.at = NEXT[self.at]
            self.sink("I", None, NAMES[self.at], "")


def _second_pass(turns: DataFrame, also: DataFrame | None) -> DataFrame:
    """Turns (kind 1), checkpoints (kind 0) and the conversations of ``also`` (kind 2) as one stream."""
    rows = _prepared(turns)
    both = rows.withColumns({"kind": F.lit(1), "block": F.lit(0)}).unionByName(checkpoints(rows).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    if also is not None:
        both = both.unionByName(also.select("conv_id", F.lit(2).alias("kind")), allowMissingColumns=True)
    return _streamed(both, backwards=False).select(
        "kind", "conv_id", "turn", "role", "text", "blank", "again", "cut", "n", "nothing", "system", "user", "assistant"
    )


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Summary:
    def __init__(self):
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.edits, self.digest, self.emitted, self.before = [], hashlib.sha256(), 0, None
        self.walk = Walk(self.edit)

    def edit(self, edit: str, turn: int | None, role: str, text: str) -> None:
        self.edits.append(edit)
        if edit != "D":
            self.digest.update((("\n" if self.emitted else "") + f"{role}:{text}").encode())
            self.emitted += 1

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += not blank and not again and cut
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.walk.turn(turn, role, text, _state(blank, again, cut))

    def row(self) -> tuple:
        if self.before is not None:
            self.walk.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.walk.cost or 0, "".join(self.edits), self.digest.hexdigest()


def summaries(turns: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Faults, cost, edits and the SHA-256 of the repaired ``role:text`` lines of every conversation.

    ``turns`` are (conv_id, turn, role, text). Null roles and texts are one space, null
    turns come first, turns with one number are ordered by role, beginning and hash of the
    text; of repeated rows all but the first are duplicates, and a null conv_id is a
    conversation like others. ``also`` lists conversations (conv_id) that may have no
    turns: they have zeros, no edits and the hash of the empty string. No rows, no
    conversations. Other columns are not read.
    """
    kind = turns.limit(0).select("conv_id").toArrow().schema.field(0).type
    schema = StructType([turns.schema["conv_id"]])
    for part in SUMMARY.split(", "):
        schema = schema.add(*part.split(" "))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, summary = None, None
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
        for what, conv_id, turn, role, text, blank, again, cut, n, *costs in _rows(batches):
            if summary is None or conv_id != current:
                if summary is not None:
                    out.append((current, *summary.row()))
                    if len(out) >= 2_000:
                        yield flush()
                        out.clear()
                current, summary = conv_id, _Summary()
            if what == 0:
                summary.walk.checkpoint(n, tuple(costs))
            elif what == 1:
                summary.add(turn, role, text, blank, again, cut)
        if summary is not None:
            out.append((current, *summary.row()))
            yield flush()

    return _second_pass(turns, also).mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): every edit of every conversation, in order from 0.

    Rows other than deletions (D) are the repaired conversation; inserted turns (I) have a
    null turn and an empty text, K keeps and R gives another role. For nulls, ties, repeated
    rows and empty tables see ``summaries``.
    """
    kinds = turns.limit(0).select("conv_id", "turn").toArrow().schema
    schema = StructType([turns.schema["conv_id"]]).add("place", "long").add("edit", "string")
    schema = schema.add(turns.schema["turn"]).add("role", "string").add("text", "string")
    types = [kinds.field(0).type, pa.int64(), pa.string(), kinds.field(1).type, pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, walk, place = None, None, 0

        def sink(*edit) -> None:
            nonlocal place
            out.append((current, place, edit[0], *edit[1:]))
            place += 1

        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
        for what, conv_id, turn, role, text, blank, again, cut, n, *costs in _rows(batches):
            if walk is None or conv_id != current:
                if walk is not None:
                    walk.end()
                current, walk, place = conv_id, Walk(sink), 0
            if what == 0:
                walk.checkpoint(n, tuple(costs))
            elif what == 1:
                walk.turn(turn, role, text, _state(blank, again, cut))
            if len(out) >= 1_000:
                yield flush()
                out.clear()
        if walk is not None:
            walk.end()
        if out:
            yield flush()

    return _second_pass(turns, None).mapInArrow(run, schema)


# -- damage, to repair again ------------------------------------------------------------


def damage_kind(conv_id: Column, turn: Column) -> Column:
    """crc32 of ``conv_id:turn`` modulo 20, null parts as one space."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn))) % 20


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with every twentieth dropped, emptied, stripped of ``.!?``, repeated or made user's.

    Null roles and texts become one space.
    """
    kind, text = damage_kind(F.col("conv_id"), F.col("turn")), F.coalesce("text", F.lit(" "))
    times = F.when(kind == 0, F.array()).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.explode(times).alias("copy"),
    ).drop("copy")
