"""Scalar rules for pipeline health and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import round_half_even
from tidemark.vocab import SLO_TOLERANCE


def expected_duration(task_count: Column) -> Column:
    """Half a minute plus 20 s per task, one minute at least."""
    return F.greatest(F.lit(60.0), 30.0 + task_count * 20.0)


def slo_ok(actual: Column, expected: Column) -> Column:
    """Within tolerance; unknown or zero durations count as fine."""
    known = (F.coalesce(actual, F.lit(0.0)) != 0) & (F.coalesce(expected, F.lit(0.0)) != 0)
    return F.when(known, actual <= expected * SLO_TOLERANCE).otherwise(True)


def percentage(part: Column, whole: Column, digits: int) -> Column:
    return round_half_even(part / F.greatest(whole, F.lit(1)) * 100.0, digits)


def success_rate(runs: Column, failures: Column) -> Column:
    return percentage(runs - failures, runs, 1)


def slo_bar(actual: Column, expected: Column) -> Column:
    """Share of the bar to fill; a missing duration counts as 0 s."""
    actual, expected = (F.coalesce(c, F.lit(0.0)) for c in (actual, expected))
    return F.least(F.lit(100.0), expected / F.greatest(actual, F.lit(1.0)) * 100.0)


def has_rich_metadata(is_real: Column, schedule: Column, *lists: Column) -> Column:
    filled = F.coalesce(schedule, F.lit("")) != ""
    for items in lists:
        filled = filled | (F.coalesce(F.size(items), F.lit(0)) > 0)
    return is_real & filled


def quality_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent")
        .when(score >= 70, "Needs attention")
        .otherwise("Poor quality")
    )


def null_band(null_pct: Column) -> Column:
    return F.when(null_pct > 10, "high").when(null_pct > 5, "medium").otherwise("low")


def progress_pct(current: Column, total: Column) -> Column:
    """Whole percent, cut off towards zero."""
    return (current / F.greatest(total, F.lit(1)) * 100).cast("long")
