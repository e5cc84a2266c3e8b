"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidemark", cores: str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _session_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this session's part of the shared folder."""
    return f"{_session_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder, once no result needs it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    A written table survives the loss of any executor, and each later step scans
    it instead of recomputing what came before.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Rows an iteration finds, one written folder per round.

    However many rounds there are, reading all of them is a single scan.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.schema, self.path, self.number = spark, schema, shared_path(spark, label), -1

    def add(self, rows: DataFrame) -> DataFrame:
        self.number += 1
        folder = f"{self.path}/round={self.number}"
        rows.write.parquet(folder)
        return self.spark.read.schema(self.schema).parquet(folder)

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)
