"""The stored index against a scan: exact with lists skipped, approximate with most hits found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_retrieval import brute, vectors
from tidemark.operators import vector_index
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans.inputs import table


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 3
    store = np.concatenate([c + rng.normal(size=(120, 24)) * 0.4 for c in centres])
    store[300:780] = store[0]  # a third are copies of one row
    store[7] = 0.0
    asked = np.concatenate([store[::50], rng.normal(size=(5, 24)), np.zeros((1, 24))])
    return store, asked


def hits(found):
    return {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}


def test_exact_with_lists_skipped(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK_ROWS", 100)
    store, asked = clustered
    index = VectorIndex.build(vectors(spark, store, "id").repartition(5), str(tmp_path / "index"))
    lists = index.lists.toPandas()
    assert lists.n.sum() == len(store) and list(lists[lists.part == -1].n) == [1]
    assert index.packs("ids").select(F.max(F.size("ids"))).first()[0] < 160  # the copies' list is spread out
    queries = vectors(spark, asked, "query_id")
    again = VectorIndex(spark, index.path)  # as another session would
    assert hits(again.exact_top_k(queries, 5)) == brute(asked, store, 5)
    _, rest = again.plan(queries, 5)
    looked, every = rest.count() + len(asked), len(asked) * len(lists)
    assert looked < 0.6 * every, (looked, every)


def test_bounds_hold(spark, clustered, tmp_path):
    store, asked = clustered
    index = VectorIndex.build(vectors(spark, store, "id"), str(tmp_path / "index"))
    part = {r["id"]: r["part"] for r in index.rows.select("id", "part").collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit(asked.astype(np.float32).astype(float)) @ unit(store.astype(np.float32).astype(float)).T
    for r in index.bounds(vectors(spark, asked, "query_id")).collect():
        inside = [i for i, p in part.items() if p == r["part"]]
        assert scores[r["query_id"], inside].max() <= r["bound"] + 1e-9


def test_small_and_empty_stores(spark, tmp_path):
    asked, store = vectors(spark, np.eye(3), "query_id"), vectors(spark, np.eye(3)[:2], "id")
    for name, rows, n in (("two", store, 6), ("none", store.limit(0), 0), ("zero", vectors(spark, np.zeros((2, 3)), "id"), 6)):
        index = VectorIndex.build(rows, str(tmp_path / name))
        assert index.exact_top_k(asked, 5).count() == n and index.approximate_top_k(asked, 5).count() == n
        assert index.exact_top_k(asked.limit(0), 5).count() == 0


def test_missing_vectors_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("r", None)], "query_id string, embedding array<float>")
    assert [tuple(r)[:3] for r in VectorIndex.build(rows, str(tmp_path / "i")).exact_top_k(asked).collect()] == [("q", 1, "a")]


def test_recall_on_the_supplied_vectors(spark, sf_dir, tmp_path):
    """Every 50th vector as a query, against all: at least nine of ten neighbours are found."""
    rows = table(spark, sf_dir.replace("0.001", "0.1"), "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(rows, str(tmp_path / "index"))
    probes = index.probes_for(0.97, 10)
    exact = {(r["query_id"], r["id"]) for r in index.exact_top_k(queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in index.approximate_top_k(queries, 10, probes).collect()}
    recall = len(near & exact) / len(exact)
    assert len(exact) == 400 and recall >= 0.9 and probes < index.lists.count(), (recall, probes)
    print(f"recall {recall} with {probes} of {index.lists.count()} lists")


def test_build_without_arrow_conversion(spark, clustered, tmp_path):
    """Sessions that do not set Arrow for pandas, as clusters bring them, build and search the same index."""
    store, asked = clustered
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        index = VectorIndex.build(vectors(spark, store, "id"), str(tmp_path / "plain"))
        assert hits(index.exact_top_k(vectors(spark, asked, "query_id"), 5)) == brute(asked, store, 5)
        none = VectorIndex.build(vectors(spark, store, "id").limit(0), str(tmp_path / "none"))
        assert none.lists.count() == 0 and none.exact_top_k(vectors(spark, asked, "query_id"), 5).count() == 0
    finally:
        spark.conf.set(setting, before)
