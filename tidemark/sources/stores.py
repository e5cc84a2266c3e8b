"""Tables kept as parquet: full refresh, guarded refresh, state, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and file system of a location."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` that a finished job has written."""
    place, system = filesystem(spark, path)
    if not system.exists(place):
        return []
    folders = [s.getPath() for s in system.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    done = [f for f in folders if system.exists(filesystem(spark, f"{f.toString()}/_SUCCESS")[0])]
    return sorted(int(f.getName().split("=")[1]) for f in done)


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace the table by a new version of it in a folder of its own.

    A version counts from the moment its job has left the mark of success, which is its
    last step; until then, and if it fails, readers see the one before. Nothing is moved.
    The version before stays for those who are still reading it, older ones go.
    """
    spark = df.sparkSession
    versions = _numbered(spark, path, "version")
    number = versions[-1] + 1 if versions else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in versions[:-1]:
        place, system = filesystem(spark, f"{path}/version={old}")
        system.delete(place, True)


def newest_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest whole version of a table."""
    versions = _numbered(spark, path, "version")
    return f"{path}/version={versions[-1]}" if versions else None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version of a table; no rows before the first."""
    newest = newest_version(spark, path)
    return spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema)


def guarded_refresh(df: DataFrame, path: str) -> bool:
    """Replace the table only when there is a row to write."""
    if df.isEmpty():
        return False
    full_refresh(df, path)
    return True


def latest_state(runs: DataFrame, key: str, value: str, at: list[str]) -> DataFrame:
    """The newest value of every key of an append-only table."""
    return runs.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias(value))


# Changes are appended as numbered batches, so a small change never rewrites a large
# store. A batch that runs again after a failure is a new version of just that batch.


def _batches(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of the newest whole version of every batch that a finished job has written."""
    place, system = filesystem(spark, f"{path}/batch=*/version=*/_SUCCESS")
    newest: dict[int, tuple[int, str]] = {}
    for status in system.globStatus(place) or []:
        folder = status.getPath().getParent()
        batch, version = (int(f.getName().split("=")[1]) for f in (folder.getParent(), folder))
        newest[batch] = max(newest.get(batch, (-1, "")), (version, folder.toString()))
    return {batch: folder for batch, (_, folder) in sorted(newest.items())}


def write_batch(
    rows: DataFrame, path: str, batch: int, reset: bool = False, key: str = "id", order: list[str] | None = None
) -> None:
    """Write one batch, one row per key: the one with the greatest ``order`` columns.

    Without ``order`` all other columns decide, so the row kept does not hang on the
    order of reading. Until the job is done readers see the batch as it was before.
    """
    if reset:
        place, system = filesystem(rows.sparkSession, path)
        system.delete(place, True)
    others = [c for c in rows.columns if c != key]
    first = order or others
    payload = F.struct(*first, *(c for c in others if c not in first))
    single = rows.groupBy(key).agg(F.max(payload).alias("row")).select(key, "row.*").select(*rows.columns)
    full_refresh(single, f"{path}/batch={batch}")


def read_store(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Current rows: of each key the one from its newest batch; none of a missing store.

    Only batches whose job has finished are read. A store of one batch is read as it is.
    Else keys and batch numbers are shuffled to find the keys written more than once, and
    texts and vectors of others stay where they are if those keys are few.
    """
    batches = list(_batches(spark, path).values())
    if not batches:
        return spark.createDataFrame([], schema)
    if len(batches) == 1:
        return spark.read.schema(schema).parquet(batches[0])
    reader = spark.read.schema(f"{schema}, batch long, version long").option("basePath", path)
    rows = reader.parquet(*batches).drop("version")
    rewritten = (
        rows.groupBy(key)
        .agg(F.max("batch").alias("newest"), F.count("*").alias("times"))
        .where(F.col("times") > 1)
        .select(key, "newest")
    )
    current = F.coalesce("newest", "batch") == F.col("batch")
    return rows.join(materialise(rewritten, "rewritten-keys"), key, "left").where(current).drop("batch", "newest")


def compact(spark: SparkSession, path: str, schema: str, to: str, key: str = "id") -> None:
    """Write the current rows as the first batch of a new store."""
    write_batch(read_store(spark, path, schema, key), to, 0, reset=True, key=key)
