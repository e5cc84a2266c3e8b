"""Repair of conversations against a plain search over all edits, and odd tables."""

import hashlib
import random
import re
import sys
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import turns

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}
TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Summary of one conversation's (turn, role, text), in order: the least of all (cost, audit)."""
    seen, marks = set(), []
    for _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        marks.append("b" if not chars else "d" if (role, text) in seen else "" if chars[-1] in ".!?" else "t")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, then, line):
            if then:
                found.append((cost + then[0], edit + then[1], (*line, *then[2])))

        if inserted < 2:
            add(5, "I", best(i, NEXT[state], inserted + 1), (NAMES[NEXT[state]] + ":",))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", best(i + 1, state, 0), ())
            if marks[i] not in ("b", "d"):
                open_ = 5 * (marks[i] == "t")
                add(1 + open_, "R", best(i + 1, NEXT[state], 0), (f"{NAMES[NEXT[state]]}:{text}",))
                if (state, role[:1]) in KEPT:
                    add(open_, "K", best(i + 1, KEPT[state, role[:1]], 0), (f"{role}:{text}",))
        return min(found, key=lambda f: f[:2]) if found else None

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, "", 0)
    initials = [role[:1] for _, role, _ in rows]
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    faults = [marks.count(m) for m in "bdt"]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation(rng, n):
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", "A long answer. ", "a.\x0b", None, "é?", "x "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ubuntu"]
    rows, turn = [], rng.choice([None, 0, 5])
    for i in range(n):
        text = rng.choice(texts) if rng.random() < 0.5 else f"Text {i}" + rng.choice([".", "!", ""])
        rows.append((turn, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[i % 2], text))
        turn = rng.choice([turn, None]) if turn is None else turn + rng.choice([1, 1, 1, 2, 9])
        turn = 0 if turn is None and rng.random() < 0.7 else turn
    return rows


def test_against_all_edits(spark):
    rng = random.Random(11)
    lengths = [*range(8), *(rng.randint(1, 30) for _ in range(150)), 17, 63, 64, 65, 144, 400]
    table = [(None if c == 20 else c, *row) for c, n in enumerate(lengths) for row in conversation(rng, n)]
    rng.shuffle(table)
    ids = spark.createDataFrame([(None if c == 20 else c,) for c in range(len(lengths))], "conv_id long")
    frame = spark.createDataFrame(table, TURNS).repartition(7).withColumns({"kind": F.lit("x"), "n": F.lit(1), "head": F.lit(2)})
    grouped = defaultdict(list)
    heads = frame.select("conv_id", "turn", F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.xxhash64(F.coalesce("text", F.lit(" "))))
    for conv_id, *row in heads.collect():
        grouped[conv_id].append(row)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], r[3])
    found = {r[0]: tuple(r)[1:] for r in turns.summaries(frame, ids).collect()}
    assert len(found) == len(lengths)
    for conv_id, row in found.items():
        assert row == plain([tuple(r[:3]) for r in sorted(grouped[conv_id], key=order)]), conv_id
    for conv_id, lines in _by_conversation(turns.repair(frame)).items():
        assert "".join(line["edit"] for line in lines) == found[conv_id][6]
        text = "\n".join(f"{line['role']}:{line['text']}" for line in lines if line["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == found[conv_id][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(line["role"][:1] for line in lines if line["edit"] != "D"))


def _by_conversation(edits):
    found = defaultdict(list)
    for row in sorted(edits.collect(), key=lambda r: r["place"]):
        found[row["conv_id"]].append(row)
    return found


def test_checkpoints_grow_with_the_root(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(10_000)] + [(2, 0, "user", "Hm.")]
    marks = turns.checkpoints(turns._prepared(spark.createDataFrame(rows, TURNS))).collect()
    sizes = [r["n"] for r in marks if r["conv_id"] == 1]
    assert sum(sizes) == 10_000 and len(sizes) <= 25 and max(sizes) <= 2 * turns.BLOCK * 25
    assert [r["n"] for r in marks if r["conv_id"] == 2] == [1]


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "w " * 300_000 + "!")]
    found = turns.summaries(spark.createDataFrame(rows, TURNS)).first()
    assert (found["duplicate"], found["cost"], found["audit"]) == (499, 998, "K" + "D" * 499 + "K")


def test_insert_where_a_turn_must_stay():
    """Deleting is cheaper than inserting, so the walk is asked directly."""
    seen = []
    walk = turns.Walk(lambda *edit: seen.append(edit))
    walk.checkpoint(1, (9, 9, 5, 9))
    walk.turn(0, "user", "Hm.", turns.FINE)
    walk.end()
    assert [e[0] for e in seen] == ["K", "I"] and seen[1][2:] == ("assistant", "")


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert turns.summaries(none).count() == 0 and turns.repair(none).count() == 0 and turns.damaged(none).count() == 0
    only = turns.summaries(none, spark.createDataFrame([(3,), (3,), (None,)], "conv_id long")).collect()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r)[1:] for r in only} == {3: empty, None: empty} and len(only) == 2


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(12) for t in range(25)] + [(None, None, None, None), (None, 3, None, "x.")]
    import zlib

    want = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " ")
        want += [(conv_id, turn, "user" if kind == 4 else role or " ", text)] * {0: 0, 3: 2}.get(kind, 1)
    found = [tuple(r) for r in turns.damaged(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("state", [turns.FINE, turns.CUT, turns.GONE])
def test_costs_never_differ_by_more_than_two_inserts(state):
    """So checkpoints stay small numbers apart, however long the conversation."""
    costs = turns.AT_END
    for initial in "uuasxua" * 40:
        costs = turns.before(costs, initial, state)
        assert max(costs) - min(costs) <= 2 * turns.INSERT
