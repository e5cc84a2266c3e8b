"""Workflow definitions in their many forms."""

import pytest

from tidemark.operators import workflows

COLUMNS = "file_ord long, path string, content string"


def parse(spark, *contents):
    rows = [(i, f"d{i}.py", c) for i, c in enumerate(contents)]
    return workflows.parse_workflows(spark.createDataFrame(rows, COLUMNS))


def one(spark, content):
    return [r.asDict() for r in parse(spark, content).orderBy("dag_ord").collect()]


def test_call_form(spark):
    (found,) = one(spark, '''
from airflow import DAG
with DAG("main", schedule="@daily", default_args={"owner": "ann", **more, "retries": 2}, owner="bob",
         tags=["x", "y", "x", 3], description="d", catchup=True, max_active_runs=4) as dag:
    a = BashOperator(task_id="one"); b = airflow.MyOperator(task_id="two"); c = other(task_id="no")
    d = CustomHttpSensorX(task_id="one"); e = PythonOperator(task_id=name)
    @task
    def three(): pass
    @task.branch(retries=1)
    def not_a_task(): EmptyOperator(task_id="four")
    @x.task()
    async def five(): pass
''')
    assert found["dag_id"] == "main" and found["schedule"] == "@daily" and found["by_syntax"]
    assert found["tasks"] == ["one", "two", "three", "four", "five"]
    assert found["owners"] == ["ann", "bob"] and found["tags"] == ["x", "y"]
    assert (found["description"], found["catchup"], found["max_active_runs"]) == ("d", True, 4)


def test_defaults(spark):
    (found,) = one(spark, 'import airflow\nd = airflow.DAG(dag_id="a", schedule_interval=timedelta(1), max_active_runs=0, catchup=FLAG)')
    assert (found["schedule"], found["tasks"], found["owners"], found["tags"]) == ("", [], [], [])
    assert (found["description"], found["catchup"], found["max_active_runs"]) == ("", False, 1)


def test_decorator_forms(spark):
    found = one(spark, '''
@dag
def bare():
    """About bare."""
@dag(schedule="@hourly", description="")
def called():
    "ignored"
@decorators.dag("named")
async def other(): pass
@decorators.dag
def attribute_only(): pass
''')
    assert [(r["dag_id"], r["schedule"], r["description"]) for r in found] == [
        ("bare", "", "About bare."), ("called", "@hourly", ""), ("named", "", ""),
    ]


def test_definitions_inside_functions_are_found_by_pattern_only(spark):
    inner = 'def make():\n    return DAG("inner", schedule_interval="@weekly")\n'
    (found,) = one(spark, inner)
    assert (found["dag_id"], found["schedule"], found["by_syntax"]) == ("inner", "@weekly", False)
    found = one(spark, inner + 'd = DAG("outer")\n')
    assert [r["dag_id"] for r in found] == ["outer"]
    assert [r["dag_id"] for r in one(spark, 'class A:\n    d = DAG("in_class")\n')] == ["in_class"]


def test_broken_files_use_patterns(spark):
    (found,) = one(spark, '''
x = DAG( 'broken', schedule='@once', default_args={'owner': 'ann', "owner" : "ann"}, tags=['p', "q"])
t = Op(task_id='b'); u = Op(task_id="a"); v = Op(task_id='b')
def (:
''')
    assert (found["dag_id"], found["schedule"], found["tasks"]) == ("broken", "@once", ["b", "a"])
    assert (found["owners"], found["tags"], found["by_syntax"]) == (["ann"], ["p", "q"], False)
    (found,) = one(spark, "@dag(\n schedule='x')\ndef by_name(): pass\ndef (:")
    assert found["dag_id"] == "by_name"
    assert one(spark, "from airflow import x\ndef (:") == []


@pytest.mark.parametrize("content, found", [("x = 1", 0), ("FROM AIRFLOW import q\n", 0), ("DAG (\"a\")", 1)])
def test_files_without_definitions(spark, content, found):
    assert parse(spark, content).count() == found


def test_unreadable_ids_and_huge_numbers(spark):
    (found,) = one(spark, "@dag(dag_id=NAME)\ndef f(): pass")
    assert found["dag_id"] is None
    (found,) = one(spark, "d = DAG('a', max_active_runs=99999999999999999999)")
    assert found["max_active_runs"] == 1


def test_last_definition_wins(spark):
    dags = parse(spark, 'd = DAG("a", tags=["one"]); e = DAG("b")', 'd = DAG("a", tags=["two"])',
                 "@dag(dag_id=X)\ndef f(): pass", "@dag(dag_id=X)\ndef g(): pass")
    assert dags.count() == 5
    kept = workflows.registry(dags)
    assert sorted((r["dag_id"] or "", r["tags"]) for r in kept.collect()) == [("", []), ("", []), ("a", ["two"]), ("b", [])]
    rows = workflows.exploded(kept.where("dag_id is not null"), "tags").collect()
    assert {(r["dag_id"], r["item"]) for r in rows} == {("a", "two"), ("b", None)}


def test_files_nested_too_deeply_are_listed(spark):
    texts = {
        "good.py": 'from airflow import DAG\nDAG("good")', "sum.py": "import airflow\nx = " + "+".join(["y"] * 40_000),
        "minus.py": "import airflow\nx = " + "-" * 60_000 + "1", "broken.py": 'from airflow import DAG\nDAG("by_pattern"\ndef (:\ndag_id = "named"',
    }
    files = spark.createDataFrame([(i, *item) for i, item in enumerate(texts.items())], "file_ord long, path string, content string")
    read = workflows.read_workflows(files)
    assert {tuple(r) for r in workflows.skipped_files(read).collect()} == {("sum.py", "nested too deeply"), ("minus.py", "nested too deeply")}
    assert {r["source_file"] for r in workflows.definitions(read).collect()} == {"good.py", "broken.py"}


def test_a_task_without_memory_fails():
    assert workflows._unreadable(MemoryError()) is None
    assert workflows._unreadable(MemoryError("Parser stack overflowed")) == "nested too deeply"
