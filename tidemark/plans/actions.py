"""Named actions over the registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.quality import quality_check

VIEWS = {"get_tables": "catalog", "get_lineage": "lineage", "get_health": "pipeline_health"}


def register_views(catalog: DataFrame, lineage: DataFrame, pipelines: DataFrame) -> None:
    for name, rows in zip(VIEWS.values(), (catalog, lineage, pipelines)):
        rows.createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """The views as SQL table functions: ``SELECT * FROM get_lineage()``. An unknown name is an error of the query."""
    for action, view in VIEWS.items():
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(view).schema.fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {action}() RETURNS TABLE ({fields}) RETURN SELECT * FROM {view}")


def run_action(spark: SparkSession, action: str, table_name: str = "") -> DataFrame:
    """The rows of a view, or the quality check of a table or view; other names fail."""
    if action == "trigger_quality_check":
        return quality_check(spark.table(table_name), table_name)
    if action not in VIEWS:
        raise KeyError(f"unknown action: {action}")
    return spark.table(VIEWS[action])
