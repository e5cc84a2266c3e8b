"""Pipeline health: run logs, registry, duration targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import (
    expected_duration,
    has_rich_metadata,
    percentage,
    quality_band,
    slo_bar,
    slo_ok,
    success_rate,
)

REGISTRY_FIELDS = (
    "schedule", "tasks", "owners", "tags", "source_file", "description", "catchup",
    "max_active_runs",
)
OBSERVED = ("status", "last_run", "duration_actual", "failure_count", "run_count", "last_error")


def observed_runs(run_log: DataFrame) -> DataFrame:
    """Latest run and run counts of every workflow.

    ``max_by`` and the counts combine on the map side, so a workflow with a third of
    all runs costs one row per input partition. One aggregate per column lets a report
    without errors leave their texts unread.
    """
    newest = F.struct("ts", "run_id")
    return run_log.groupBy("dag_id").agg(
        F.max_by("status", newest).alias("status"),
        F.max("ts").alias("last_run"),
        F.max_by("duration_s", newest).alias("duration_actual"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.count("*").alias("run_count"),
        F.max_by("error", newest).alias("last_error"),
    )


def health_from_runs(run_log: DataFrame, registry: DataFrame) -> DataFrame:
    """Health rows of all workflows that ran; registered ones have a target."""
    known = registry.select("dag_id", expected_duration(F.size("tasks")).alias("duration_expected"))
    return (
        observed_runs(run_log)
        .join(known, "dag_id", "left")
        .withColumn("is_real", F.col("duration_expected").isNotNull())
    )


def sync_health(health: DataFrame, registry: DataFrame, run_log: DataFrame) -> DataFrame:
    """Merge the registry into the health rows.

    Real rows keep what was observed and take the new target; registered workflows
    without a real row get one from the run log; other rows go, except real rows
    that left the registry. An empty registry changes nothing.
    """
    targets = registry.select(
        "dag_id", expected_duration(F.size("tasks")).alias("target")
    )
    old = health.where("is_real").withColumn("kept", F.lit(True))
    runs = observed_runs(run_log).select(
        "dag_id", *(F.col(c).alias(f"new_{c}") for c in OBSERVED)
    )
    merged = old.join(targets, "dag_id", "full_outer").join(runs, "dag_id", "left")

    def take(column: str) -> Column:
        return F.when(F.col("kept"), F.col(column)).otherwise(F.col(f"new_{column}"))

    synced = merged.where(F.col("kept") | F.col("target").isNotNull()).select(
        "dag_id",
        take("status").alias("status"),
        take("last_run").alias("last_run"),
        take("duration_actual").alias("duration_actual"),
        F.coalesce("target", "duration_expected").alias("duration_expected"),
        F.coalesce(take("failure_count"), F.lit(0)).alias("failure_count"),
        F.coalesce(take("run_count"), F.lit(0)).alias("run_count"),
        F.coalesce(take("last_error"), F.lit("")).alias("last_error"),
        F.lit(True).alias("is_real"),
    )
    empty = registry.limit(1).agg(F.count("*") == 0).scalar()
    return synced.where(~empty).unionByName(
        health.select(*synced.columns).where(empty)
    )


def with_scores(health: DataFrame) -> DataFrame:
    actual, expected = F.col("duration_actual"), F.col("duration_expected")
    return (
        health.withColumn("slo_ok", slo_ok(actual, expected))
        .withColumn("success_rate", success_rate(F.col("run_count"), F.col("failure_count")))
        .withColumn("slo_bar", slo_bar(actual, expected))
    )


def pipelines(health: DataFrame, registry: DataFrame) -> DataFrame:
    """Scored health rows; real ones carry what the registry knows about them."""
    known = registry.select(F.col("dag_id").alias("reg_id"), *REGISTRY_FIELDS)
    joined = with_scores(health).join(
        known, (F.col("dag_id") == F.col("reg_id")) & F.col("is_real"), "left"
    )
    return joined.drop("reg_id").withColumn(
        "rich", has_rich_metadata(F.col("is_real"), F.col("schedule"), F.col("tasks"), F.col("owners"), F.col("tags"))
    )


def in_category(category: str) -> Column:
    return {
        "failed": F.col("status") == "failed",
        "slo": ~F.col("slo_ok"),
        "ok": (F.col("status") == "success") & F.col("slo_ok"),
        "real": F.col("is_real"),
    }.get(category, F.lit(True))


def critical(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("slo_ok") | (F.col("status") == "failed"))


def slo_summary(scored: DataFrame) -> DataFrame:
    totals = scored.agg(
        F.count("*").alias("total_pipelines"),
        F.count_if("slo_ok").alias("slo_passing"),
        F.count_if("is_real").alias("real_dag_count"),
    )
    share = percentage(F.col("slo_passing"), F.col("total_pipelines"), 1)
    return totals.select(
        "total_pipelines",
        "slo_passing",
        (F.col("total_pipelines") - F.col("slo_passing")).alias("slo_failing"),
        share.alias("slo_percentage"),
        quality_band(share).alias("slo_band"),
        "real_dag_count",
        (F.col("real_dag_count") > 0).alias("has_real_data"),
    )


def failing(scored: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Pipelines whose latest run failed, with the error; on one day if given."""
    failed = F.col("status") == "failed"
    if as_of is not None:
        failed = failed & (F.to_date("last_run") == as_of)
    return scored.where(failed).select("dag_id", "last_run", "last_error")
