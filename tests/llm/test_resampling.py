"""Importance resampling against a plain restatement, and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import frame
from tidemark.llm import resampling


def plain(docs, target, longest, buckets, percent, least, seed):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = (Counter(b for text in texts for b in runs(text)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows, drawn = [], []
    for doc_id, text in docs:
        n, found = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(found), weight, score, None])
        drawn += [(-score, doc_id is not None, doc_id or 0, rows[-1])] if n >= least else []
    drawn.sort(key=lambda d: d[:3])
    for place, (*_, row) in enumerate(drawn[: percent * len(drawn) // 100]):
        row[4] = place + 1
    return rows


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_plain(spark, odd, odd_rows, longest, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.PORTION_BYTES", 1 << 12)
    target = ["w1 w2 w3 w1 w2", "Café 日本語 x-y", None, "", "w9\0w9"]
    model = resampling.fit(odd, spark.createDataFrame([(t,) for t in target], "text string"), longest, 500)
    found = [list(r) for r in resampling.resample(odd, model, percent=50, least_words=3, seed=7).collect()]
    want = plain([r[:2] for r in odd_rows], target, longest, 500, 50, 3, 7)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    strip = lambda rows: sorted((r[:4] for r in rows), key=order)
    assert strip(found) == strip(want)
    ranked = lambda rows: [r[:4] for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])]
    assert ranked(found) == ranked(want) and len(ranked(found)) > 3
    assert sorted(r[4] for r in found if r[4]) == [*range(1, len(ranked(want)) + 1)]


def test_runs_stay_in_their_document():
    memo = resampling._Buckets(1 << 30)
    batch = [b"a b", b"", b"c", b"d e f", b"g\0h", b"\0"]
    owners, found, n_words = resampling.features(batch, 2, memo)
    want = [(0, b"a"), (0, b"b"), (2, b"c"), (3, b"d"), (3, b"e"), (3, b"f"), (4, b"g"), (4, b"h"), (0, b"a b"), (3, b"d e"), (3, b"e f"), (4, b"g h")]
    assert list(zip(owners, found)) == [(d, zlib.crc32(g) % (1 << 30)) for d, g in want]
    assert n_words.tolist() == [2, 0, 1, 3, 2, 0]
    assert [len(x) for x in resampling.features([], 2, memo)] == [0, 0, 0]


def test_portions_cover_every_row(odd):
    from tidemark.llm.common import portions

    table = odd.select("doc_id", "text").toArrow()
    for size in (1, 100, 10_000, 1 << 30):
        parts = [p for batch in table.to_batches() for p in portions([batch], size)]
        assert [r for p in parts for r in p.to_pylist()] == table.to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) + 64 for t in p.column("text").to_pylist()) <= size for p in parts)


def test_empty_tables(spark, odd, none):
    target = spark.createDataFrame([("w1",)], "text string")
    assert resampling.resample(none, resampling.fit(none, target)).count() == 0
    model = resampling.fit(none, target.limit(0))
    assert not model.gains.any()
    assert {r["weight"] for r in resampling.weigh(odd, model).collect()} == {0}


def test_rows_alike_are_all_ranked(spark):
    rows = frame(spark, [(3, "a b c d")] * 300 + [(i, f"t{i} a b c") for i in range(100)])
    model = resampling.fit(rows, spark.createDataFrame([("a b",)], "text string"))
    found = resampling.resample(rows, model, percent=100, least_words=1).toPandas()
    assert sorted(found["rank"]) == list(range(1, 401))
    ordered = found.sort_values("rank")
    assert (np.diff(ordered.score) <= 0).all()
