"""Running figures over streams, and the vector store kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scoring import progress_pct
from tidemark.functions.text import round_half_even
from tidemark.operators.chunking import line_chunks
from tidemark.operators.health import observed_runs
from tidemark.sources.stores import write_batch


def read_files_as_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A growing set of parquet files; zone-less times become session-zone times."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # A path with a pattern may name a single file as well as a folder.
    stream = reader.parquet(path[:-1] + f"[{path[-1]}]")
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def _elapsed(time: str) -> Column:
    """Seconds from the first to the last time of a group."""
    return (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6


def throughput(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Events per key, seconds from the first to the last, and the rounded rate."""
    elapsed = F.col("elapsed_s")
    return (
        events.groupBy(key)
        .agg(
            F.count("*").alias("events"),
            _elapsed(time).alias("elapsed_s"),
        )
        # Half a unit up, as the displayed rate rounds.
        .withColumn("per_second", F.when(elapsed > 0, F.floor(F.col("events") / elapsed + 0.5)).otherwise(0))
    )


def latest_progress(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per run, its percentage and the seconds since the first one."""
    state = F.struct("stage", "current", "total", "message", "done")
    return (
        snapshots.groupBy("run_id")
        .agg(
            F.max_by(state, F.struct("ts", "seq")).alias("last"),
            _elapsed("ts").alias("elapsed"),
        )
        .select(
            "run_id",
            "last.*",
            progress_pct(F.col("last.current"), F.col("last.total")).alias("pct"),
            round_half_even(F.col("elapsed"), 1).alias("elapsed_s"),
        )
    )


PROGRESS_STATE = "first long, ts long, seq long, stage string, current bigint, total bigint, message string, done boolean"


def closing_progress(snapshots: DataFrame, idle: str = "1 hour") -> DataFrame:
    """``latest_progress`` on a stream whose state ends: a finished run is let go.

    A run that said it is done is kept for ``idle`` after its newest snapshot, so late
    ones still count, and then its state is dropped; open runs stay. The watermark is as
    late. Every trigger gives the runs that changed.
    """
    wait = int(snapshots.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {idle})").first()[0])
    fields = ["stage", "current", "total", "message", "done"]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, *last = state.get if state.exists else (None, None, None, *[None] * len(fields))
        for rows in batches:
            if rows.empty:
                continue
            low, newest = int(rows["us"].min()), rows.sort_values(["us", "seq"]).iloc[-1]
            first = low if first is None else min(first, low)
            if last[0] is None or (int(newest["us"]), int(newest["seq"])) >= (last[0], last[1]):
                last = [int(newest["us"]), int(newest["seq"]), *(None if pd.isna(newest[f]) else newest[f] for f in fields)]
        if last[0] is None:
            return
        values = [None if v is None else v.item() if hasattr(v, "item") else v for v in (first, *last)]
        state.update(tuple(values))
        done = bool(values[-1])
        if done:
            state.setTimeoutTimestamp(max(values[1] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *values[3:], (values[1] - values[0]) / 1e6)], columns=["run_id", *fields, "elapsed"])

    raw = "run_id {0}, stage string, current bigint, total bigint, message string, done boolean, elapsed double".format(
        snapshots.schema["run_id"].dataType.simpleString()
    )
    followed = (
        snapshots.withWatermark("ts", idle).withColumn("us", F.unix_micros("ts"))
        .groupBy("run_id").applyInPandasWithState(follow, raw, PROGRESS_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )
    pct = progress_pct(F.col("current"), F.col("total"))
    return followed.select("run_id", *fields, pct.alias("pct"), round_half_even(F.col("elapsed"), 1).alias("elapsed_s"))


def windowed_runs(run_log: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Runs and failures per workflow and day of a run-log stream, late rows up to ``delay``."""
    return (
        run_log.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "dag_id")
        .agg(
            F.count("*").alias("run_count"),
            F.count_if(F.col("status") == "failed").alias("failure_count"),
        )
        .select(F.col("window.start").alias("since"), "dag_id", "run_count", "failure_count")
    )


def append_windows(run_log: DataFrame, path: str, checkpoint: str, delay: str, width: str = "1 day") -> StreamingQuery:
    """Append the windows that the watermark has closed to a parquet folder.

    A window is written once, when no row within ``delay`` can still fall into it, and
    its state is dropped then; rows that come later than that are left out.
    """
    return (
        windowed_runs(run_log, delay, width)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_health(run_log: DataFrame) -> DataFrame:
    """The latest run of every workflow, on a stream."""
    return observed_runs(run_log)


def keep_table(updates: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append every batch of changed rows as a numbered batch of a store.

    Reading the store gives the newest row per key; a batch that runs again after a
    failure replaces itself.
    """

    def save(rows: DataFrame, batch: int) -> None:
        write_batch(rows, path, batch, key=key)

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_chunks(
    files: DataFrame,
    path: str,
    checkpoint: str,
    encode: Callable[[DataFrame], DataFrame] = lambda chunks: chunks,
) -> StreamingQuery:
    """Chunk arriving files and upsert the chunks by id."""

    def save(rows: DataFrame, batch: int) -> None:
        write_batch(encode(line_chunks(rows)), path, batch)

    return (
        files.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
