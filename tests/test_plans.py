"""What the plans of all queries must and must not hold."""

import re

from tidemark.operators import health
from tidemark.plans.inputs import table
from tidemark.plans.queries import run


def test_scans_read_only_what_is_needed(spark, data, sf_dir):
    runs = table(spark, sf_dir, "events")
    plan = runs.where("user_id = 3").select("value")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(user_id,3\)", plan)
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan
    plan = health.slo_summary(health.with_scores(data.health))._jdf.queryExecution().toString()
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_firsts_are_cut_before_the_shuffle(spark, sf_dir):
    for name in ("g4_recent_checks", "d7_history_tails", "d3_cosine_top_k"):
        physical = run(name, spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert physical.count("WindowGroupLimit") == 2  # before and after the exchange


def test_code_files_are_made_once(data):
    found = data.corpus
    for step in (found.files, found.chunks, found.texts, found.raw_edges):
        read = step.inputFiles()
        assert read and all("/code-files-" in path for path in read)
