"""One query per operator of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import hamming, jaccard, packing, pieces, ppm, quality, repacking, resampling, secrets, sharding, substring, toxicity, turns
from tidemark.llm.common import documents, held_out, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = settle(sharding.assign(documents(spark, sf_dir), 8), "shards")
    numbered = sharding.number(placed, "shard", ["doc_id", "size", "text_crc32"], placed.count())
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return toxicity.score_texts(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_tokens", F.size("passages").alias("n_passages"),
    )


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(documents(spark, sf_dir))
    return found.rows.join(found.classes.select("cls", "component_id"), "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code")
    )
    asked = coded.where("id % 50 = 0").select(F.col("id").alias("query_id"), "code")
    return hamming.top_k(asked, coded, 10).withColumnRenamed("id", "vec_id")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.joined(of(*secrets.BASE)), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = settle(packing.pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")), "pieces")
    key = F.struct("doc_id", "start", "ids_crc32")
    return packing.pack(cut, cut.count(), key, "length", F.col("length") - 1)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeated(documents(spark, sf_dir), with_text=False)
    removed = F.aggregate("spans", F.lit(0), lambda total, s: total + s["end"] - s["start"])
    return done.select("doc_id", F.col("n_words").cast("long").alias("n_words"), removed.cast("long").alias("n_removed"), "kept_sha256")


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 5, 1)
    model = ppm.fit(docs.where(~out))
    return ppm.score(docs, model).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    dropped = original.where(turns.damage_kind(F.col("conv_id"), F.col("turn")) == 0)
    return turns.summaries(turns.damaged(original), dropped)


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repacking.pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return repacking.pack(cut)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = resampling.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return resampling.resample(docs, model)
