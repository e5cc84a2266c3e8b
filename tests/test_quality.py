"""Profiles, scores, rounding and health rules."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.text import has_text, round_half_even, strip
from tidemark.operators import health, quality


def test_rounding_is_exact(spark):
    rng = random.Random(1)
    values = [66.25, 2.675, 0.125, 0.375, 1.005, 2.5, -2.5, -0.125, 1e300, -66.35, 0.0, 33.35, 1 / 3 * 100]
    values += [rng.uniform(-200, 200) for _ in range(2000)]
    values += [a / b * 100 for a in range(0, 60) for b in range(1, 60)]
    values += [k / 8 for k in range(-200, 200)] + [k / 1000 + 0.0005 for k in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4):
        found = rows.select("v", round_half_even(F.col("v"), digits).alias("r")).collect()
        assert [r["r"] for r in found] == [round(r["v"], digits) for r in found]


def test_strip_matches_all_white_space(spark):
    texts = ["  a b  ", "\x1c\u2003x\u00a0\u3000", "\u200b", "\n\t", "", "a\u2028", "\x85é\x85"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", strip(F.col("t")).alias("s"), has_text(F.col("t")).alias("full")).collect()
    assert [r["s"] for r in found] == [r["t"].strip() for r in found]
    assert [r["full"] for r in found] == [bool(r["t"].strip()) for r in found]


CLASSES = {
    "int": ["1", " 42 ", "+7", "-0", "1_000", "20240101", "9" * 25],
    "float": ["1.", ".5", "1.5e3", "inf", "-Infinity", "nan", "-nan", "+inf", "1_2.5_0e1_0", "1.e5", "+.5"],
    "date": ["2024-1-5", "2024-01-05", "31/12/2024", "12/31/2024", "2024-01-05T10:20:30"],
    "text": [
        "1__0", "_1", "1_", "1e", "e5", "1d", "1f", "0x1f", "--1", "1 2", "- 1", ".", "+", "e", "abc", "infi", "1._5", "1_.5",
        "1e_5", "1_e5", "1__2.5", "2024-13-01", "2024-02-30", "2024-001-5", "31/31/2024", "2024-01-05T25:00:00", "2024-01-05 10:20:30",
    ],
    None: ["", "  "],
}


def test_cell_classes(spark):
    expected = {cell: kind for kind, cells in CLASSES.items() for cell in cells}
    rows = spark.createDataFrame([(c,) for c in expected], "c string")
    found = rows.select("c", quality.cell_class(F.col("c")).alias("k"), quality.cell_number(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["k"] for r in found} == expected
    for r in found:
        if r["k"] in ("int", "float"):
            assert r["n"] == float(r["c"]) or (math.isnan(r["n"]) and math.isnan(float(r["c"])))


def test_very_long_cells(spark):
    cells = ["9" * 200_000 + "x", "1_" * 100_000, "1_" * 100_000 + "1", "1" * 4000 + ".5" * 2]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    found = rows.select("i", quality.cell_class(F.col("c")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in found] == ["text", "text", "int", "text"]


@pytest.mark.parametrize(
    "cells, expected",
    [
        (["1"] * 9 + ["x"], "integer"),
        (["1"] * 8 + ["x"] * 2, "float"),  # 0.8 is not above 0.8
        (["1.5"] * 7 + ["x"] * 3, "string"),  # 0.7 is not above 0.7
        (["1.5"] * 8 + ["x"] * 2, "float"),
        (["2024-01-01"] * 8 + ["1"] * 2, "date"),
        (["", " "], "unknown"),
        (["a", "1"], "string"),
    ],
)
def test_inferred_types(spark, cells, expected):
    table = spark.createDataFrame([(c,) for c in cells], "`a.b` string")
    assert quality.type_profile(table, ["a.b"]).first()["inferred_type"] == expected
    assert quality.profile(table).first()["inferred_type"] == expected


def test_upper_medians(spark):
    rng = random.Random(3)
    groups = {
        "even": [1.0, 2.0, 3.0, 4.0], "odd": [5.0, 1.0, 3.0], "one": [7.0], "negative": [-1.5, -2.5, 0.0, -0.0, 1e-300, -1e300],
        "copies": [2.0] * 50 + [1.0] * 49 + [3.0], "infinite": [float("-inf"), 1.0, float("inf")],
        "random": [rng.choice([rng.gauss(0, 1e6), rng.random() * 1e-5, float(rng.randint(-9, 9))]) for _ in range(3001)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    counted = spark.createDataFrame(rows, "column string, number double").groupBy("column", "number").agg(F.count("*").alias("n"))
    found = {r["column"]: r["median"] for r in quality.upper_medians(counted).collect()}
    assert found == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}


def test_profile_figures(spark):
    rows = [("1", "a@b", "x"), ("2", " ", "x"), ("3", "a@b", "x"), ("4", "c@d", ""), ("oops", "c@d", "x")] + [("10", "e", "x")] * 2
    table = spark.createDataFrame(rows, "qty string, email string, note string")
    found = {r["name"]: r for r in quality.profile(table).collect()}
    qty = found["qty"]
    assert (qty["inferred_type"], qty["type_mismatches"], qty["unique_count"], qty["null_count"]) == ("integer", 1, 6, 0)
    numbers = [1, 2, 3, 4, 10, 10]
    mean = sum(numbers) / 6
    std = math.sqrt(sum((n - mean) ** 2 for n in numbers) / 6)
    assert tuple(qty["numeric_stats"]) == (1, 10, mean, round(std, 4), 4)
    assert (found["email"]["is_pii"], found["email"]["null_pct"], found["email"]["unique_pct"]) == (True, 14.29, 42.86)
    assert found["note"]["numeric_stats"] is None

    summary = quality.quality_summary(quality.profile(table), quality.duplicate_rows(table))
    row = summary.first()
    assert (row["total_rows"], row["duplicate_rows"], row["total_nulls"], row["total_mismatches"]) == (7, 1, 2, 1)
    assert row["quality_score"] == round((1 - 2 / 21 - 1 / 7 - 1 / 21) * 100, 2)
    told = [(r["severity"], r["message"]) for r in quality.issues(quality.profile(table), summary).orderBy("place", "pos").collect()]
    assert told == [
        ("warning", "High null rate (>5%) in: email, note"),
        ("error", "1 duplicate rows detected"),
        ("warning", "Type mismatches in 'qty': 1 non-integer values"),
        ("info", "PII detected in: email"),
    ]


def test_clean_and_empty_tables(spark):
    clean = spark.createDataFrame([(str(i), "x") for i in range(20)], "a string, b string")
    profiled = quality.profile(clean)
    summary = quality.quality_summary(profiled, quality.duplicate_rows(clean))
    assert summary.first()["quality_score"] == 100.0 and summary.first()["quality_band"] == "Excellent"
    assert [r["message"] for r in quality.issues(profiled, summary).collect()] == ["Data quality looks excellent!"]
    assert quality.duplicate_rows(clean.limit(0)).first()[:] == (0, 0)
    assert quality.quality_check(clean.limit(0), "t").first()["quality_score"] == 100.0


def test_null_rows_are_duplicates_too(spark):
    table = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", None), ("a", 1)], "a string, b int")
    assert quality.duplicate_rows(table).first()["duplicate_rows"] == 2
    check = quality.quality_check(table, "t", {"a": "int"}).first()
    assert check["null_counts"] == {"a": 2, "b": 2} and not check["passed"]
    assert [tuple(m) for m in check["schema_mismatches"]] == [("a", "int", "string", 3)]
    assert check["quality_score"] == round((1 - 6 / 10) * 100, 2)
    shares = {r["column"]: r["null_share"] for r in quality.null_shares(quality.quality_check(table, "t")).collect()}
    assert shares == {"a": 0.4, "b": 0.4}


def test_one_cell_value_in_a_third_of_all_rows(spark):
    table = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("a"))
    row = quality.distinct_profile(table, ["a"]).first()
    assert (row["rows"], row["unique_count"]) == (9000, 6000)
    assert abs(quality.distinct_profile(table, ["a"], approximate=True).first()["unique_count"] - 6000) < 600
    assert quality.duplicate_rows(table).first()["duplicate_rows"] == 2999


# -- health -------------------------------------------------------------------------------------------

HEALTH = "dag_id string, status string, duration_actual double, duration_expected double, failure_count long, run_count long, last_error string, is_real boolean"
RUN_ROWS = [
    ("slow_but_passing", "success", 110.0, 100.0, 0, 10, "", False),
    ("too_slow", "success", 111.0, 100.0, 1, 9, "", False),
    ("fast_but_failed", "failed", 1.0, 60.0, 2, 7, "boom", False),
    ("slow_and_failed", "failed", 500.0, 60.0, 3, 4, "worse", False),
    ("never_ran", "running", 0.0, 60.0, 0, 0, "", False),
    ("fine", "success", 30.0, 60.0, 0, 3, "", False),
    ("fine_too", "success", 59.0, 60.0, 0, 1, "", False),
]


def test_known_health_rows(spark):
    scored = health.with_scores(spark.createDataFrame(RUN_ROWS, HEALTH))
    total = health.slo_summary(scored).first()
    assert (total["total_pipelines"], total["slo_passing"], total["slo_failing"], total["slo_percentage"]) == (7, 5, 2, 71.4)
    assert (total["real_dag_count"], total["has_real_data"]) == (0, False)
    assert {r["dag_id"] for r in health.critical(scored).collect()} == {"too_slow", "fast_but_failed", "slow_and_failed"}
    rates = {r["dag_id"]: r["success_rate"] for r in scored.collect()}
    assert (rates["fast_but_failed"], rates["slow_and_failed"], rates["too_slow"], rates["never_ran"]) == (71.4, 25.0, 88.9, 0.0)


def test_scalar_rules(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [pick(scoring.expected_duration(lit(n))) for n in (0, 1, 2, 5)] == [60.0, 60.0, 70.0, 130.0]
    null = lit(None).cast("double")
    assert [pick(scoring.slo_ok(a, lit(100.0))) for a in (lit(110.0), lit(111.0), lit(0.0), null)] == [True, False, True, True]
    assert pick(scoring.slo_ok(lit(5.0), lit(0.0))) and pick(scoring.slo_ok(lit(5.0), null))
    assert pick(scoring.slo_bar(lit(0.5), lit(0.4))) == 40.0 and pick(scoring.slo_bar(lit(10.0), lit(40.0))) == 100.0
    assert pick(scoring.success_rate(lit(0), lit(0))) == 0.0
    assert [pick(scoring.null_band(lit(v))) for v in (10.1, 10.0, 5.1, 5.0)] == ["high", "medium", "medium", "low"]
    assert [pick(scoring.progress_pct(lit(a), lit(b))) for a, b in ((1, 3), (2, 3), (5, 0), (0, 0))] == [33, 66, 500, 0]


REGISTRY = "dag_id string, schedule string, tasks array<string>, owners array<string>, tags array<string>, source_file string, description string, catchup boolean, max_active_runs long"
RUNS = "dag_id string, run_id long, ts timestamp, status string, duration_s double, error string"


def _registry(spark, *ids):
    return spark.createDataFrame([(i, "", ["a", "b", "c"], [], [], "f", "", False, 1) for i in ids], REGISTRY)


def test_health_sync(spark):
    at = datetime(2024, 1, 1)
    columns = "dag_id string, status string, last_run timestamp, duration_actual double, duration_expected double, failure_count long, run_count long, last_error string, is_real boolean"
    old = spark.createDataFrame(
        [("kept", "failed", at, 5.0, 1.0, 1, 2, "x", True), ("gone", "success", at, 6.0, 2.0, 0, 3, "", True),
         ("demo", "success", at, 7.0, 3.0, 0, 4, "", False)], columns)
    runs = spark.createDataFrame(
        [("kept", 1, at, "success", 1.0, ""), ("demo", 1, at, "running", 9.0, ""), ("demo", 2, at, "failed", 8.0, "boom")], RUNS)
    found = {r["dag_id"]: r for r in health.sync_health(old, _registry(spark, "kept", "demo", "new"), runs).collect()}
    assert set(found) == {"kept", "gone", "demo", "new"}
    assert (found["kept"]["status"], found["kept"]["duration_expected"]) == ("failed", 90.0)
    assert (found["gone"]["duration_expected"], found["gone"]["run_count"]) == (2.0, 3)
    assert (found["demo"]["status"], found["demo"]["duration_actual"], found["demo"]["failure_count"]) == ("failed", 8.0, 1)
    assert (found["new"]["status"], found["new"]["run_count"], found["new"]["last_error"]) == (None, 0, "")
    assert all(r["is_real"] for r in found.values())
    same = health.sync_health(old, _registry(spark).limit(0), runs)
    assert {r["dag_id"] for r in same.collect()} == {"kept", "gone", "demo"}


def test_registry_fields_only_for_real_rows(spark):
    rows = spark.createDataFrame([*RUN_ROWS[:1], ("d", "success", 1.0, 90.0, 0, 1, "", True)], HEALTH)
    found = {r["dag_id"]: r for r in health.pipelines(rows, _registry(spark, "d", "slow_but_passing")).collect()}
    assert found["d"]["tasks"] == ["a", "b", "c"] and found["d"]["rich"]
    assert found["slow_but_passing"]["tasks"] is None and not found["slow_but_passing"]["rich"]
