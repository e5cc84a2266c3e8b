"""Chunks, vectors, neighbours and prompts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.md5 import md5_heads
from tidemark.operators import chunking, retrieval


def cut(spark, texts, size=400):
    files = spark.createDataFrame([(f"f{i}.py", t) for i, t in enumerate(texts)], "path string, content string")
    found = {}
    for r in chunking.line_chunks(files, size).orderBy("file", "chunk").collect():
        assert r["id"] == hashlib.md5(f"{r['file']}:{r['chunk']}".encode()).hexdigest() and r["type"] == "python"
        found.setdefault(r["file"], []).append((r["chunk"], r["text"]))
    return [found.get(f"f{i}.py", []) for i in range(len(texts))]


@pytest.mark.parametrize(
    "text, chunks",
    [
        ("", []),
        (" \n\t", []),
        ("x", [(0, "x")]),
        ("x" * 50, [(0, "x" * 50)]),
        ("x" * 49 + "\n\ny", [(0, "x" * 49 + "\n\ny")]),  # 49 + 0 + 1 characters
        ("x" * 50 + "\n", [(0, "x" * 50)]),  # what is left is blank
        ("a\n" + " " * 60 + "\nend", [(0, "a"), (1, "end")]),  # blanks count, and are cut off
        (" " * 60 + "\nend", [(1, "end")]),  # a blank chunk keeps its number
        ("é" * 49 + "\nß\nz", [(0, "é" * 49 + "\nß"), (1, "z")]),
    ],
)
def test_chunks_of_known_texts(spark, text, chunks):
    assert cut(spark, [text], 50) == [chunks]


def test_chunks_close_at_the_size(spark):
    """Lines without blanks: chunks join back to the text, and each is as short as it can be."""
    rng = random.Random(4)
    texts = ["\n".join("x" * rng.randint(1, 300) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for size in (400, 50):
        for text, chunks in zip(texts, cut(spark, texts, size)):
            assert [n for n, _ in chunks] == list(range(len(chunks)))
            assert "\n".join(t for _, t in chunks) == text
            for _, chunk in chunks[:-1]:
                lengths = [len(line) for line in chunk.split("\n")]
                assert sum(lengths) >= size > sum(lengths[:-1])


def test_a_batch_of_long_texts_is_cut_in_portions():
    """However much text a batch has, a few MB of it are in Python form at a time, and all of it comes out."""
    texts = ["\n".join(f"{i} line {n}" for n in range(100_000)) for i in range(12)] + ["", "short", "x" * 9_000_000]
    batch = retrieval.pa.record_batch({"file": [str(i) for i in range(len(texts))], "content": texts})
    parts = list(chunking._cutter(400)([batch]))
    assert len(parts) >= 5 and max(p.nbytes for p in parts) < 10_000_000
    found = {}
    for r in (r for p in parts for r in p.to_pylist()):
        found.setdefault(r["file"], []).append(r["text"])
    assert {f: "\n".join(t) for f, t in found.items()} == {str(i): t for i, t in enumerate(texts) if t}


def test_chunks_are_made_batch_by_batch(spark):
    files = spark.createDataFrame([("a.md", "x\ny")], "path string, content string")
    plan = chunking.line_chunks(files)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_one_very_long_text_is_cut_whole(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    files = spark.createDataFrame([("a.md", text)], "path string, content string")
    found = chunking.line_chunks(files).orderBy("chunk").collect()
    assert "\n".join(r["text"] for r in found) == text


def vectors(spark, matrix, key):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def brute(queries, store, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(queries.astype(np.float32).astype(float)) @ unit(store.astype(np.float32).astype(float)).T, 9)
    return {(q, r + 1): int(i) for q, row in enumerate(scores) for r, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:k])}


@pytest.mark.parametrize("block", [retrieval.QUERY_BLOCK, 7])
def test_exact_neighbours(spark, block):
    rng = np.random.default_rng(0)
    store, asked = rng.normal(size=(600, 16)), rng.normal(size=(40, 16))
    store[100:300] = store[0]  # a third are copies of one row
    asked[0], store[5] = store[0], 0.0
    rows = vectors(spark, store, "id").repartition(7)
    found = retrieval.cosine_top_k(vectors(spark, asked, "query_id"), rows, 5, block)
    physical = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in physical and "hashpartitioning(block" not in physical  # the store stays where it is
    found = found.collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in found} == brute(asked, store, 5)
    assert [r["id"] for r in sorted(found) if r["query_id"] == 0] == [0, 100, 101, 102, 103]


def test_many_queries_take_as_many_jobs_as_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    store, asked = rng.normal(size=(300, 4)), rng.normal(size=(3_000, 4))
    rows, queries = vectors(spark, store, "id"), vectors(spark, asked, "query_id")
    jobs = {}
    for block in (4_096, 50):
        spark.sparkContext.setJobGroup(f"block {block}", "")
        found = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.cosine_top_k(queries, rows, 3, block).collect()}
        jobs[block] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"block {block}"))
        assert found == brute(asked, store, 3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[50] - jobs[4_096]) <= 1  # the adaptive planner may split a stage off
    monkeypatch.setattr(retrieval, "PACK_CELLS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # queries too many for every task
    try:
        sorted_way = retrieval.cosine_top_k(queries, rows, 3, 50)
        assert "SortMergeJoin" in sorted_way._jdf.queryExecution().toString()
        assert {(r["query_id"], r["rank"]): r["id"] for r in sorted_way.collect()} == found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_queries_meet_the_store_in_a_grid(spark, monkeypatch):
    """More queries than a task holds: groups and shares, no packed store repeated per block."""
    monkeypatch.setattr(retrieval, "FEW", 100)
    monkeypatch.setattr(retrieval, "GROUP_QUERIES", 400)
    rng = np.random.default_rng(7)
    store, asked = rng.normal(size=(900, 8)), rng.normal(size=(1_000, 8))
    store[100:400] = store[0]  # a third are copies of one row
    asked[:50], asked[60], store[5] = store[0], 0.0, 0.0
    queries, rows = vectors(spark, asked, "query_id"), vectors(spark, store, "id")
    found = retrieval.cosine_top_k(queries, rows, 4)
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert {(r["query_id"], r["rank"]): r["id"] for r in found.collect()} == brute(asked, store, 4)
    assert retrieval.cosine_top_k(queries, rows.limit(0), 4).count() == 0
    assert retrieval.cosine_top_k(queries, rows.limit(3), 4).count() == 3_000


def test_a_task_gives_k_rows_per_query_only(spark):
    """Rows that come by in many packs leave at most k hits per query, however many blocks meet them."""
    rng = np.random.default_rng(8)
    store, asked = retrieval._unit(rng.normal(size=(5_000, 8))), rng.normal(size=(40, 8)).astype(np.float32)
    top = retrieval._Top(retrieval.pa.array(range(40)), asked, 3)
    for at in range(0, 5_000, 500):
        top.add(np.arange(at, at + 500), store[at : at + 500])
    rows = [r for batch in top.result() for r in batch.to_pylist()]
    assert len(rows) == 120
    ranked = {q: [r["id"] for r in sorted(rows, key=lambda r: (-r["score"], r["id"])) if r["query_id"] == q] for q in range(40)}
    assert {(q, i + 1): hit for q, hits in ranked.items() for i, hit in enumerate(hits)} == brute(asked, store, 3)


def test_small_and_empty_stores(spark):
    asked, store = vectors(spark, np.eye(2), "query_id"), vectors(spark, np.eye(2)[:1], "id")
    assert retrieval.cosine_top_k(asked, store, 5).count() == 2
    assert retrieval.cosine_top_k(asked, store.limit(0), 5).count() == 0
    assert retrieval.cosine_top_k(asked.limit(0), store, 5).count() == 0


def test_approximate_neighbours_find_most(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12)) * 3
    store = np.concatenate([c + rng.normal(size=(100, 12)) * 0.5 for c in centres])
    store[:300] = centres[0] + rng.normal(size=(300, 12)) * 0.1  # one crowded side
    asked = store[::20]
    queries, rows = vectors(spark, asked, "query_id"), vectors(spark, store, "id")
    exact = {(r["query_id"], r["id"]) for r in retrieval.cosine_top_k(queries, rows, 5).collect()}
    near = {(r["query_id"], r["id"]) for r in retrieval.approximate_top_k(queries, rows, 5).collect()}
    assert len(near) == len(exact) and len(near & exact) / len(exact) > 0.9
    every = retrieval.approximate_top_k(queries, rows, 5, bits=6, flips=6).collect()
    assert {(r["query_id"], r["id"]) for r in every} == exact


def test_signatures_are_sides_of_planes(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(50, 10)).astype(np.float32)
    found = vectors(spark, matrix, "id").select("id", retrieval.signature(F.col("embedding"), 5).alias("s")).collect()
    planes = np.array([[1 - 2 * ((i & (2 * j + 1)).bit_count() % 2) for i in range(10)] for j in range(5)])
    assert {r["id"]: r["s"] for r in found} == {i: sum(1 << j for j in range(5) if planes[j] @ v > 0) for i, v in enumerate(matrix.astype(float))}


def test_word_vectors(spark):
    texts = ["alpha beta beta", "alpha gamma", "Déjà vu, alpha_1!", "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = retrieval.TermWeights.fit(rows, 64)
    found = [r["embedding"] for r in weights.encode(rows).orderBy("id").collect()]
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64
    idf = lambda n: np.log(5 / (1 + n))
    expected = np.zeros(64)
    expected[slot("alpha")] += idf(2)
    expected[slot("beta")] += 2 * idf(1)
    assert np.allclose(found[0], expected / np.linalg.norm(expected), atol=1e-6)
    assert found[2][slot("déjà")] > 0 and not any(found[3])


def test_word_vectors_of_many_texts(spark):
    """Texts of all lengths over several parts of a batch; a missing text has no vector."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(0, 30))) for _ in range(5_000)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    idf = tuple(float(i + 1) for i in range(128))
    found = [r["embedding"] for r in retrieval.TermWeights(idf).encode(rows).orderBy("id").collect()]
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 128
    expected = np.zeros((5_000, 128))
    for i, text in enumerate(texts[:-1]):
        for word in text.split():
            expected[i, slot(word)] += idf[slot(word)]
    assert found[-1] is None
    assert (np.array(found[:-1], np.float32) == retrieval._unit(expected).astype(np.float32)).all()


def test_any_encoder_can_be_plugged_in(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert [r["embedding"] for r in retrieval.encode_with(rows, load).orderBy("id").collect()] == [[2.0, 1.0], [4.0, 1.0]]


def test_prompts(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)] + [(2, 0, "user", "only")]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chunks = spark.createDataFrame([("a", "f.py", "python", "A"), ("b", None, None, "B")] + [(c, "g", "text", c) for c in "cd"],
                                   "id string, file string, type string, text string")
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 4, "d"), (1, 3, "c")], "query_id long, rank int, id string")
    found = {r["conv_id"]: r["prompt"] for r in retrieval.prompts(talk, retrieval.contexts(hits, chunks)).collect()}
    assert found[2] == "USER: only\n\nA:"
    assert found[1] == (
        "RELEVANT CODEBASE CONTEXT:\n[f.py]\nA\n---\n[?]\nB\n---\n[g]\nc\n\n"
        "CONVERSATION HISTORY:\nUSER: m2\nASSISTANT: m3\nUSER: m4\nASSISTANT: m5\n\nUSER: m6\n\nA:"
    )
    named = [(r["rank"], r["file"], r["type"]) for r in retrieval.sources(hits, chunks, 3).orderBy("rank").collect()]
    assert named == [(1, "f.py", "python"), (2, "?", "?"), (3, "g", "text")]


def test_a_conversation_with_most_turns(spark):
    talk = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    tails = retrieval.history_tails(talk)
    assert tails.where("conv_id = -1").first()["history"] == "\nUSER: 4994\nUSER: 4996\nUSER: 4997\nUSER: 4999"
    assert "WindowGroupLimit" in tails._jdf.queryExecution().toString()


def test_md5_of_many_words():
    """All lengths around the ends of a number and of a block, and letters of several bytes."""
    rng = random.Random(3)
    words = ["", *("x" * n for n in range(1, 130)), *("".join(rng.choice("aé語𝒳0_") for _ in range(rng.randint(1, 30))) for _ in range(500))]
    coded = [w.encode() for w in words]
    sizes = np.array([len(w) for w in coded])
    heads = md5_heads(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert heads.tolist() == [int(hashlib.md5(w).hexdigest()[:8], 16) for w in coded]


def test_words_are_split_once(spark):
    """Weights and vectors made of written slots are those made of the texts, and split no text."""
    texts = ["alpha beta beta", "İstanbul ΣΑΣ", "Déjà vu, alpha_1!", "...", "", "x" * 200, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    slotted = rows.select("id", retrieval.word_slots(F.col("text"), 64).alias("slots"))
    weights = retrieval.TermWeights.fit(slotted, 64)
    assert weights == retrieval.TermWeights.fit(rows, 64)
    assert weights.encode(slotted).select("id", "embedding").orderBy("id").collect() == weights.encode(rows).select("id", "embedding").orderBy("id").collect()
    assert weights.encode(rows).columns == ["id", "text", "embedding"]
    assert "regexp_extract_all" not in weights.encode(slotted.localCheckpoint())._jdf.queryExecution().toString()


@pytest.mark.parametrize("signed", [False, True])
def test_bounds_are_never_below_the_products(signed):
    rng = np.random.default_rng(11)
    queries, rows = (retrieval._unit(rng.normal(size=(300, 40)) * (rng.random((300, 40)) < 0.4)) for _ in range(2))
    if not signed:
        queries, rows = np.abs(queries), np.abs(rows)
    for pairs in (20, 15, 10):
        bound = retrieval._Bounds(rng.random(40), pairs)
        numbers, others = bound.of_queries(queries), bound.of_rows(rows)
        assert numbers.shape[1] == 40 - pairs
        assert (numbers @ others.T >= queries @ rows.T - 1e-6).all()


@pytest.mark.parametrize("signed", [False, True])
def test_bounds_leave_the_best_rows(signed):
    """Most rows are looked at by fewer numbers than a vector has, and the hits are those of all products."""
    rng = np.random.default_rng(12)
    draw = lambda n: rng.gamma(0.3, size=(n, 32)) * np.where(signed, rng.choice([-1, 1], (n, 32)), 1) * (rng.random((n, 32)) < 0.3)
    store, asked = retrieval._unit(draw(12_000)), draw(1_100).astype(np.float32)
    store[500:900], store[7_000], asked[5], asked[9] = store[3], 0.0, 0.0, store[3]
    top = retrieval._Top(retrieval.pa.array(range(1_100)), asked, 3)
    for at in range(0, 12_000, 700):
        top.add(np.arange(at, min(at + 700, 12_000)), store[at : at + 700])
    assert len(top.bounds) == 3 and top.level.min() < 3
    rows = [r for batch in top.result() for r in batch.to_pylist()]
    ranked = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], -r["score"], r["id"])):
        ranked.setdefault(r["query_id"], []).append(r["id"])
    exact = np.round(retrieval._unit(asked.astype(float)) @ store.T, 9)
    expected = {q: np.lexsort((np.arange(12_000), -row))[:3].tolist() for q, row in enumerate(exact)}
    assert ranked == expected


def test_store_goes_to_the_grid_in_packs(spark, monkeypatch):
    """Every row is in one pack of the part its key belongs to, and no pack is longer than it may be."""
    monkeypatch.setattr(retrieval, "PACK_ROWS", 50)
    rng = np.random.default_rng(13)
    matrix = rng.normal(size=(3_000, 4)).astype(np.float32)
    packs = retrieval._packs(vectors(spark, matrix, "id").repartition(2), "id", 7).collect()
    found = {i: (p["part"], v) for p in packs for i, v in zip(p["keys"], np.frombuffer(p["vectors"], np.float32).reshape(-1, 4))}
    assert sum(len(p["keys"]) for p in packs) == len(found) == 3_000 and len(packs) <= 2 * 7 + 3_000 / 50 * 2
    assert all((found[i][1] == v).all() for i, v in enumerate(matrix))
    parts = {r["id"]: r["part"] for r in spark.range(3_000).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("part")).collect()}
    assert {i: p for i, (p, _) in found.items()} == parts
    queries = vectors(spark, matrix, "id").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(retrieval, "FEW", 100)
    plan = retrieval.cosine_top_k(queries, vectors(spark, matrix, "id"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "vectors#" in plan and "array<array" not in plan and "Generate explode" in plan
