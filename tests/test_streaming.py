"""Streams against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import chunking, health
from tidemark.plans.queries import progress_snapshots
from tidemark.sources import stores
from tidemark.streaming import incremental


def write_parts(df, folder, parts):
    for number in range(parts):
        df.where(F.col("part") == number).drop("part").coalesce(1).write.parquet(str(folder / f"p{number}"))


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def test_rates_and_progress_over_many_batches(spark, data, tmp_path):
    events = data.table("events")
    source = tmp_path / "in"
    source.mkdir()
    events.repartition(5).write.mode("overwrite").parquet(str(source))
    for name, build, key in (
        ("rates", lambda e: incremental.throughput(e, "user_id"), "user_id"),
        ("progress", lambda e: incremental.latest_progress(progress_snapshots(e)), "run_id"),
        ("health", lambda e: health.observed_runs(e.selectExpr(
            "user_id AS dag_id", "event_id AS run_id", "ts", "event_type AS status", "value AS duration_s", "props AS error")), "dag_id"),
    ):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        updates = build(stream)
        drain(incremental.keep_table(updates, str(tmp_path / name), str(tmp_path / f"{name}-state"), key))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in updates.schema.fields)
        found = stores.read_store(spark, str(tmp_path / name), schema, key)
        assert len(list((tmp_path / name).glob("batch=*"))) == 5
        assert sorted(map(str, found.collect())) == sorted(map(str, build(events).collect()))


def test_chunks_of_arriving_and_changed_files(spark, tmp_path):
    source, store = tmp_path / "files", tmp_path / "store"
    columns = "path string, content string"
    first = spark.createDataFrame([(f"f{i}.md", "old\n" * 300 + str(i)) for i in range(6)], columns)
    changed = spark.createDataFrame([("f1.md", "new\n" * 300), ("g.md", "more")], columns)

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(columns).parquet(str(source))
        drain(incremental.ingest_chunks(stream, str(store), str(tmp_path / "state")))

    arrive(first)
    arrive(changed)
    schema = "id string, file string, chunk int, type string, text string"
    found = stores.read_store(spark, str(store), schema)
    old, new = chunking.line_chunks(first), chunking.line_chunks(changed)
    expected = old.join(new, "id", "left_anti").select(old.columns).unionByName(new)
    assert sorted(map(str, found.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert found.where("file = 'f1.md' and text like 'new%'").count() == 3


def test_daily_runs_with_late_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    columns = "dag_id string, ts timestamp, status string"
    batches = [
        [("a", at + timedelta(hours=1), "failed"), ("a", at + timedelta(hours=2), "success")],
        [("a", at + timedelta(hours=23), "success"), ("b", at + timedelta(hours=25), "failed")],
        [("a", at + timedelta(hours=60), "success")],
        [("a", at + timedelta(hours=3), "failed")],  # far too late
        [("a", at + timedelta(hours=100), "success")],
    ]
    source, query = tmp_path / "runs", None
    out = str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(columns).parquet(str(source))
        query = (
            incremental.windowed_runs(stream).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
        )
        drain(query)
    found = {(r["since"], r["dag_id"]): (r["run_count"], r["failure_count"]) for r in spark.read.parquet(out).collect()}
    assert found[(at, "a")] == (3, 1) and found[(at + timedelta(days=1), "b")] == (1, 1)


def test_state_of_finished_runs_ends(spark, tmp_path):
    at = datetime(2024, 1, 1)
    columns = "run_id long, ts timestamp, seq long, stage string, current bigint, total bigint, message string, done boolean"
    row = lambda run, hour, n, done=False: (run, at + timedelta(hours=hour), n, f"s{n}", n, 9, None, done)
    batches = [
        [row(1, 0, 1), row(2, 0, 2), row(1, 1, 3, True)],
        [row(2, 1.2, 4), row(1, 0.5, 5)],  # run 1 is done, and one of its snapshots comes late
        [row(2, 30, 6)],
        [row(2, 31, 7), row(3, 31, 8, True)],
    ]
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.closing_progress(spark.readStream.schema(columns).parquet(source), "2 hours")
        query = incremental.keep_table(stream, out, str(tmp_path / "state"), "run_id")
        drain(query)
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    assert state == [2, 2, 1, 2], state  # run 1 goes once the watermark has passed it
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    found = stores.read_store(spark, out, fields, "run_id")
    every = spark.createDataFrame([r for rows in batches for r in rows], columns)
    expected = incremental.latest_progress(every)
    assert sorted(map(str, found.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
