"""Every query on the smallest tables: its plan, and its result against its SQL counterpart."""

import numpy as np
import pandas as pd
import pytest

from tidemark.plans.inputs import TABLES
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES, run


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    return str(value.tz_localize(None)) if isinstance(value, pd.Timestamp) else str(value)


def _rows(frame):
    columns = sorted(frame.columns)
    rows = zip(*(frame[c].astype(object).map(_plain) for c in columns))
    return columns, sorted(rows, key=lambda r: tuple(v or "" for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    planned = run(name, spark, sf_dir)
    physical = planned._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in physical
    found = planned.toPandas()
    if name in ORACLES:
        assert _rows(found) == _rows(duck.execute(ORACLES[name]).fetchdf())
    else:
        assert len(found) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
