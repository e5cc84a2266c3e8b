"""The rows of the whole pipeline against a plain restatement of its five stages."""

import math
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import frame
from tidemark.llm import substring, toxicity
from tidemark.llm.common import BATCH_BYTES, BATCH_LIMIT

OPAQUE = "Zx81Kq02Lm93Pw47Rt55"


def fixture():
    """Documents and labels, with something to do for every stage."""
    rng = random.Random(11)
    names = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(600)]
    words = lambda n: [rng.choice(names) for _ in range(n)]
    docs, labels = {}, []
    for i in range(1, 41):
        body = words(60)
        if i % 4 == 0:
            for at in (5, 6, 7, 30, 31):
                body[at] = "qwertish" if at % 2 else "yuxxing"
        docs[i] = body
        if i <= 36:
            labels.append((i, int(i % 4 == 0)))
    docs[41] = [*docs[1][:30], "other", *docs[1][31:]]  # a near copy
    docs[42] = [*docs[41][:50], "another", *docs[41][51:]]
    docs[43] = [*words(20), *docs[2][10:35], *words(20)]  # a passage
    docs[44] = [*docs[3][:15], *docs[5][:15]]  # nothing but passages
    docs[45] = [*words(10), "password=hunter22x", *words(10)]
    docs[46] = ["client_id=svcmain", *words(90), OPAQUE, *words(5)]  # far apart, one scope
    docs[47] = [*words(10), OPAQUE, *words(10)]
    docs[48] = words(5000)  # longer than a sequence
    rows = {i: " ".join(body) for i, body in docs.items()}
    rows[49] = f"client_id=svcmain {' '.join(words(8))}\n \n{OPAQUE} {' '.join(words(8))}"
    return {**rows, 50: "", 51: None, 52: "a few words"}, labels


def is_toxic(text, model):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    forms = [[w, *(f"{w[:size]}*" for size in (6, 5, 4) if len(w) > size)] for w in words]
    scores = [next((model.scores[f] for f in fs if f in model.scores), model.drift) for fs in forms]
    if not any(s > 0 for s in scores):
        return False

    def best(start, end):
        total, _, i, j = max(((sum(scores[i:j]), i - j, i, j) for i in range(start, end) for j in range(i + 1, end + 1)), default=(0, 0, 0, 0))
        return [] if total <= 0 else [*best(start, i), total, *best(j, end)]

    surprise = [s - math.log(model.k * len(words)) for s in best(0, len(words))]
    evidence = sum(max(0.0, s) for s in surprise)
    return max(surprise) > 0 and 1 / (1 + math.exp(-(model.slope * evidence + model.offset))) >= 0.3


def without_near_copies(docs):
    sets = {}
    for i, text in docs.items():
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and first[a] < first[b]:
                    first[b], changed = first[a], True
    return {i: t for i, t in docs.items() if first[i] == i}


def without_passages(docs):
    windows, out = {}, {}
    split = {i: (text or "").split() for i, text in docs.items()}
    for i in sorted(docs):
        for k in range(len(split[i]) - 12):
            windows.setdefault(tuple(split[i][k : k + 13]), i)
    for i, w in split.items():
        gone = {p for k in range(len(w) - 12) if windows[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        if len(gone) < len(w) or not w:
            out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else docs[i]
    return out


def without_secrets(text):
    parts = re.split(r"(\n[ \t\r]*\n)", text or "")
    for n, part in enumerate(parts):
        if "client_id=svcmain" in part and OPAQUE in part:
            part = part.replace("client_id=svcmain", "[account]").replace(OPAQUE, "[opaque]")
        parts[n] = part.replace("password=hunter22x", "[assign]")
    return "".join(parts)


def test_run(spark, tmp_path):
    docs, labels = fixture()
    folder = str(tmp_path)
    frame(spark, list(docs.items())).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    found = corpus_pipeline.run(spark, folder).collect()

    clean = {i: t for i, t in docs.items() if not is_toxic(t, model)}
    assert set(docs) - set(clean) == {4, 8, 12, 16, 20, 24, 28, 32, 36, 40}
    single = without_near_copies(clean)
    assert set(clean) - set(single) == {41, 42}
    plain = without_passages(single)
    assert set(single) - set(plain) == {44} and plain[43] != single[43]
    masked = {i: without_secrets(t) for i, t in plain.items()}
    assert [i for i in masked if masked[i] != (plain[i] or "")] == [45, 46]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in masked.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want.append((i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == sorted(want)

    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and len(pieces) <= 128


def test_rows_go_through_python_in_small_batches(spark, tmp_path):
    """Also those that the caller of a stage writes, after the stage has returned."""
    limit = spark.conf.get(BATCH_LIMIT)
    docs = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")
    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"size": pa.array([batch.nbytes], pa.int64())})

    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(BATCH_LIMIT, limit)
            stage(spark, frame(spark, [(1, "one two three")]).drop("cls", "key", "score", "spans", "id"), str(tmp_path))
            largest = max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect())
            assert largest < 2 * BATCH_BYTES, name
    finally:
        spark.conf.set(BATCH_LIMIT, limit)


def test_stripped_rows_leave_a_portion_at_a_time(monkeypatch, spark):
    """What is made of long texts goes out before the next ones are read."""
    held = {}
    monkeypatch.setattr(substring, "tidied", lambda run: held.setdefault(run.__qualname__, run) and run)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    substring.strip_repeated(docs)
    run = next(f for name, f in held.items() if "strip_repeated" in name)
    texts = [f"{i} " * 400_000 for i in range(1, 9)]
    ids = pa.array(range(1, 9), pa.int64())
    starts = pa.array([None, [0, 1], *[None] * 6], pa.list_(pa.int32()))
    rows = {"doc_id": ids, "text": pa.array(texts), "passage_id": ids, "passage_cls": ids, "passage_text_cls": ids, "passage_least": ids, "passage_starts": starts}
    out = list(run([pa.record_batch(rows)]))
    assert len(out) > 1 and [t for b in out for t in b.column("passage_kept").to_pylist()] == [
        " ".join(["2"] * (400_000 - 14)) if i == 1 else t for i, t in enumerate(texts)
    ]
