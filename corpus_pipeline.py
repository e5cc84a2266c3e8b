"""The training-data pipeline over ``documents``: named stages, one after the other.

Each stage is written as Parquet and read again as the next one's documents. The first
four return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, packing, secrets, substring, toxicity
from tidemark.llm.common import settle, small_batches
from tidemark.llm.queries import vocabulary
from tidemark.session import materialise

ORACLE_SQL = None  # learned scores and tokenizers have no SQL; tests/llm/test_pipeline.py holds run() against a plain restatement


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, again the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic passage or with a score below 0.3, learned from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked at 0.75 on shingles of five words."""
    return jaccard.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 and more words that an earlier one has.

    A text that loses words keeps the others, joined by one space; a document that
    loses them all goes.
    """
    return _counted(substring.strip_repeated(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets."""
    return _counted(secrets.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    pieces = settle(packing.pieces(docs, vocabulary("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces, pieces.count(), F.struct("doc_id", "start", "ids_crc32"), "length", F.col("length") - 1)


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, whose rows go through Python in small batches.

    The caller writes them after the stage has returned, so the setting of the session stays.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (
        ("toxicity", drop_toxic),
        ("ngram_jaccard_join", drop_near_copies),
        ("substring_dedup", drop_repeated_passages),
        ("secret_scan", mask_secrets),
        ("packing", pack),
    )
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
