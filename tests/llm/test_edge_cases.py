"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import frame
from tidemark.llm import hamming, jaccard, packing, pieces, ppm, quality, secrets, sharding, substring, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (9, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


def test_sharding(odd, none, odd_rows):
    found = sharding.number(sharding.assign(odd, 3), "shard", ["doc_id"], len(odd_rows)).collect()
    assert ids(found) == ids([{"doc_id": r[0]} for r in odd_rows])
    assert {r["size"] for r in found if r["doc_id"] in (4, 5)} == {1}
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(none, 3).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = frame(spark, [(i, "the same text") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(400)])
    sizes = sharding.assign(rows, 4).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(sizes) == 4 and sizes.max() < 1.1 * sizes.mean()


def test_toxicity(spark, odd, none, odd_rows, labels):
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(odd, table)
        found = toxicity.score_texts(odd, model).collect()
        assert ids(found) == ids([{"doc_id": r[0]} for r in odd_rows])
        assert all(0 <= r["score"] <= 1 for r in found)
        assert toxicity.score_texts(none, model).count() == 0
        kept = toxicity.reject_toxic(odd, model, threshold=1.1)
        assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert toxicity.fit(none, labels).scores == {}


def test_jaccard(odd, none, odd_rows):
    found = jaccard.join(odd)
    rows = {r["doc_id"]: r for r in found.rows.join(found.classes.drop("doc_id"), "cls", "left").collect()}
    assert [rows[d]["component_id"] for d in (1, 2, 3, None)][:3] == [1, 1, 1]
    assert rows[7]["component_id"] == rows[8]["component_id"] == 7 and rows[7]["n"] == 1
    assert rows[9]["component_id"] == rows[10]["component_id"] == 9
    assert all(rows[d]["n"] == 0 and rows[d]["component_id"] is None for d in (4, 5, 6))
    assert rows[11]["component_id"] == 11 and rows[12]["component_id"] == 12
    assert jaccard.join(none).rows.count() == 0
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert ids(kept.collect()) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, None]
    assert jaccard.keep_first(none).count() == 0


def test_hamming(spark):
    rows = [(i, (i * 2654435761) & 0xFFFF) for i in range(300)] + [(400 + i, 77) for i in range(200)] + [(None, 5), (7000, None), (400, 77)]
    base = spark.createDataFrame(rows, "id long, code long")
    asked = spark.createDataFrame([(1, 77), (2, -1), (3, 12345), (4, None), (3, 12345)], "query_id long, code long")
    found = hamming.top_k(asked, base, 7).collect()
    plain = sorted({r for r in rows if None not in r})
    for query, code in ((1, 77), (2, -1), (3, 12345)):
        want = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10_000 + i for i, c in plain)[:7]
        assert [r["distance"] * 10_000 + r["id"] for r in sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])] == want
    assert len(found) == 21
    assert hamming.top_k(asked, base.limit(0), 7).count() == 0 and hamming.top_k(asked.limit(0), base, 7).count() == 0
    assert len(hamming.top_k(asked, base.where("id < 3"), 7).collect()) == 9
    vectors = spark.createDataFrame([([1.0] * 64,), ([-1.0, 1.0] * 32,), (None,)], "v array<double>")
    assert [r[0] for r in vectors.select(hamming.sign_code(F.col("v"))).collect()] == [-1, -6148914691236517206, None]


def test_secrets(odd, none, odd_rows):
    found = secrets.scan(odd).collect()
    assert len(found) == len(odd_rows) and all(not r["spans"] for r in found if r["doc_id"] in (4, 5, 6))
    assert secrets.scan(none).count() == 0
    masked = secrets.mask(odd)
    assert masked.columns == odd.columns and masked.count() == len(odd_rows)
    assert {r["text"] for r in masked.where("doc_id in (4, 5)").collect()} == {None, ""}


def test_quality(odd, none, odd_rows):
    found = quality.judge(odd).collect()
    assert ids(found) == ids([{"doc_id": r[0]} for r in odd_rows])
    lines = [r for r in found if r["doc_id"] in (15, 16)]
    assert [(r["n_dup_lines"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in lines] == [(2, 6, 6, True)] * 2
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)
    assert quality.judge(none).count() == 0


def test_packing(odd, none, odd_rows):
    cut = packing.pieces(odd, WORDS)
    assert {r["length"] for r in cut.where("doc_id in (4, 5, 6)").collect()} == {1}
    packed = packing.pack(cut, cut.count(), F.struct("doc_id", "start"), "length", F.lit(None)).collect()
    assert sum(r["length"] for r in packed) == sum(r["length"] for r in cut.collect())
    assert packing.pack(packing.pieces(none, WORDS), 0, F.col("doc_id"), "length", F.col("length")).count() == 0


def test_substring(odd, none, odd_rows):
    rows = {r["doc_id"]: r for r in substring.remove_repeated(odd).collect()}
    assert [rows[d]["kept"] for d in (2, 4, 5, 6, 12)] == ["", "", "", "", "k l m n o p q r s t"]
    assert not rows[1]["spans"] and not rows[None]["spans"] and not rows[8]["spans"]
    assert [tuple(s) for s in rows[3]["spans"]] == [(0, 40), (41, 90)]
    assert rows[10]["kept"] == "x"
    assert substring.remove_repeated(none).count() == 0
    kept = substring.strip_repeated(odd)
    assert kept.columns == odd.columns and 2 not in ids(kept.collect()) and 4 in ids(kept.collect())


def test_ppm(odd, none, odd_rows):
    model = ppm.fit(odd)
    found = ppm.score(odd, model).collect()
    assert ids(found) == ids([{"doc_id": r[0]} for r in odd_rows])
    assert {(r["n_tokens"], r["score"]) for r in found if r["doc_id"] in (4, 5)} == {(1, 0.0)}
    assert all(r["n_known"] == r["n_tokens"] for r in found)
    assert ppm.score(none, model).count() == 0
    blind = {r["doc_id"]: r for r in ppm.score(odd, ppm.fit(none)).collect()}
    assert blind[14]["score"] == pytest.approx(-5_000 * 2.408239965, rel=1e-6) and blind[14]["n_known"] == 0


def test_pieces(odd, none, odd_rows):
    found = pieces.round_trip(odd, PIECES).collect()
    assert len(found) == len(odd_rows) and all(r["round_trip"] for r in found)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()}
    assert all(back[d] == (t or "") for d, t, *_ in odd_rows if d is not None)
    assert pieces.round_trip(none, PIECES).count() == 0


def test_pipeline_stages(spark, odd, none, odd_rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(15, 1), *((i, 0) for i in range(1, 15))], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == start.columns
        found = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert {r["doc_id"] for r in found} >= ({4, 5, 6, 13} if start is odd else set())


@pytest.mark.parametrize("rows", [[(1, 0), (3, 1)], [], [(i, 1) for i in range(1, 16)], [(1, 0), (2, 1), (3, 1), (9, 0), (10, 1)]])
def test_labels_without_signal_drop_nothing(spark, odd, odd_rows, tmp_path, rows):
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, odd, folder)
    assert kept.columns == odd.columns and ids(kept.collect()) == ids([{"doc_id": r[0]} for r in odd_rows])


def test_evidence_still_rejects(spark):
    model = toxicity.Model({"vile": 9.0}, -0.1, 1.0, 1.0, 0.0)
    docs = frame(spark, [(1, "vile vile vile"), (2, "plain words"), (3, None)])
    assert ids(toxicity.reject_toxic(docs, model).collect()) == [2, 3]
