"""Input views derived from the supplied tables.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its
oracle read the same rows. Names in braces are other views or supplied tables.
File, table and workflow names are made from the row keys: more rows give more
files, tables and workflows. About a quarter of all load statements read the one table
``raw_hub``, so lineage has a hot key.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple(
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations".split()
)

VIEWS: dict[str, str] = {}

# One script per part. Names are layered raw -> stg -> mart/dim -> rpt.
VIEWS["script_keys"] = """
SELECT p_partkey AS k,
       p_partkey - p_partkey % 8 AS g8,
       p_partkey - p_partkey % 30 AS g30,
       CASE WHEN p_partkey % 4 = 0 THEN 'py' ELSE 'sql' END AS kind
FROM {part}
"""

VIEWS["code_files"] = '''
SELECT CAST(k AS BIGINT) AS file_ord,
  CASE WHEN k % 23 = 5 THEN concat('node_modules/pkg/f', k, '.', kind)
       WHEN k % 19 = 7 THEN concat('assets/f', k, '.csv')
       WHEN k % 17 = 3 THEN concat('docs/f', k, '.md')
       WHEN k % 13 = 2 THEN concat('conf/f', k, '.YAML')
       WHEN kind = 'py' THEN concat('dags/f', k, '.py')
       WHEN k % 11 = 1 THEN concat('sql/legacy/F', k, '.SQL')
       ELSE concat('sql/f', k, '.sql') END AS path,
  CASE WHEN k % 29 = 9 THEN concat('  ', chr(9), chr(10))
  WHEN kind = 'py' THEN concat(
    CASE WHEN k % 52 = 0 THEN 'x = 1' ELSE 'from airflow import DAG' END, chr(10),
    'LOAD = """INSERT INTO dw.mart_', g30, '_order SELECT * FROM stg_', g8, ';"""', chr(10),
    'DDL = """CREATE TABLE pyt_', g8, ' (id INT, first_name TEXT, salary INT, [time] TEXT)"""', chr(10),
    'mart_', g30, '_table_insert = """', chr(10), 'SELECT a.id FROM stg_', g8, ' a', chr(10),
    'JOIN raw.raw_hub b ON a.id = b.id', chr(10), '"""', chr(10),
    CASE WHEN k % 52 = 0 THEN '' ELSE concat(
      'with DAG("dag_', g8, '", schedule_interval="@daily", default_args=', chr(123),
      '"owner": "owner_', k % 7, '"', chr(125), ', tags=["t', k % 5, '", "etl", "etl"]) as dag:', chr(10),
      '    a = BashOperator(task_id="load_', k % 16, '")', chr(10),
      CASE WHEN k % 12 = 0 THEN concat('    b = PythonOperator(task_id="check")', chr(10)) ELSE '' END)
    END,
    CASE WHEN k % 40 = 0 THEN 'def (:' ELSE '' END)
  ELSE concat(
    CASE WHEN k % 3 = 0 THEN 'CREATE TABLE IF NOT EXISTS '
         WHEN k % 3 = 1 THEN 'create or replace table dw.' ELSE 'CREATE TEMPORARY TABLE ' END,
    CASE WHEN k % 5 = 0 THEN concat('"stg_', g8, '"') ELSE concat('stg_', g8) END,
    ' (id INT, email VARCHAR(80), amount DECIMAL(10,2), phone TEXT',
    CASE WHEN k % 3 = 0 THEN ', created_at TIMESTAMP, home_address TEXT' ELSE '' END,
    CASE WHEN k % 5 = 1 THEN concat(', "event" TEXT, key_id INT, note_', k % 7, ' TEXT') ELSE '' END,
    ', PRIMARY KEY (id));', chr(10),
    CASE WHEN k % 6 = 1 THEN concat('CREATE TABLE mart_', g30, '_orders (order_id BIGINT, cust_email TEXT, total DOUBLE);', chr(10))
         WHEN k % 6 = 3 THEN concat('CREATE TABLE dim_', g30, '_boxes (box_id BIGINT, location TEXT);', chr(10))
         ELSE '' END,
    CASE WHEN k % 6 = 1 THEN concat('INSERT INTO dw.mart_', g30, '_order SELECT s.id FROM stg_', g8,
                ' s JOIN staging.stg_', g8 + 8, ' t ON s.id = t.id;')
         WHEN k % 6 = 2 THEN concat('insert or replace into rpt_', g30, ' select * from mart_', g30,
                ' m left join dim_', g30, '_box b on m.id = b.box_id;')
         WHEN k % 6 = 3 THEN concat('INSERT INTO dim_', g30, '_box VALUES (1); INSERT INTO dim_', g30,
                '_box SELECT * FROM stg_', g8)
         WHEN k % 2 = 0 THEN concat('INSERT INTO stg_', g8, ' SELECT * FROM raw.raw_hub;')
         ELSE concat('INSERT INTO stg_', g8, ' SELECT * FROM raw.raw_', g8, '_', k % 3, ';') END, chr(10))
  END AS content
FROM {script_keys}
'''

# One workflow per supplier; users without a supplier are runs of unregistered workflows.
VIEWS["dag_registry"] = """
SELECT concat('dag_', s_suppkey) AS dag_id,
       CASE WHEN s_nationkey < 8 THEN '@daily' WHEN s_nationkey < 16 THEN '@hourly' ELSE '' END AS schedule,
       CAST(s_nationkey % 6 AS INT) AS n_tasks,
       concat('owner_', s_nationkey) AS owner,
       concat('dags/f', s_suppkey, '.py') AS source_file
FROM {supplier}
"""

VIEWS["run_log"] = """
SELECT concat('dag_', user_id) AS dag_id, event_id AS run_id, ts,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status,
       value * 4 AS duration_s,
       CASE WHEN event_type = 'error' THEN concat('RuntimeError: ', props) ELSE '' END AS error
FROM {events}
"""

# All-string cells with blanks, bad numbers and repeated rows.
VIEWS["raw_csv"] = """
SELECT row_id, id, amount, qty, order_date, email, status FROM (
  SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR(20)) AS id,
         CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN 'n/a'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(20)) END AS amount,
         CASE WHEN o_orderkey % 29 = 0 THEN 'many' ELSE CAST(o_custkey % 50 AS VARCHAR(20)) END AS qty,
         substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS order_date,
         CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('u', o_custkey, '@example.com') END AS email,
         o_orderstatus AS status
  FROM {orders}
  UNION ALL
  SELECT o_orderkey + 1000000000, CAST(o_orderkey AS VARCHAR(20)), 'n/a', 'many', '', ' ', ''
  FROM {orders} WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey + 2000000000, CAST(o_orderkey AS VARCHAR(20)), 'n/a', 'many', '', ' ', ''
  FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
) cells
"""

# Documents as files of a corpus.
VIEWS["text_files"] = """
SELECT doc_id AS file_ord, concat('docs/', source, '/', doc_id, '.md') AS path, text AS content
FROM {documents}
"""


def _needs(sql: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(sql) if name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; zone-less timestamps become session-zone timestamps (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, df[field.name].cast("timestamp"))
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    found = spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})
    # Keys are dealt out before scripts are made of them: mining takes long per byte read.
    return found.repartition(spark.sparkContext.defaultParallelism) if name == "script_keys" else found


def as_ctes(*names: str) -> list[tuple[str, str]]:
    """(name, SQL) of the views and all they need, in order of dependence."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in found:
            return
        for needed in _needs(VIEWS[name]):
            add(needed)
        found[name] = VIEWS[name].format(**{n: n for n in _needs(VIEWS[name])})

    for name in names:
        add(name)
    return list(found.items())
