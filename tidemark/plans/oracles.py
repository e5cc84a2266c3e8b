"""The same results in plain SQL for DuckDB, over the same supplied tables.

Shared steps are named views; a query's SQL is a WITH list of all it needs.
"""

from __future__ import annotations

from tidemark.functions.text import SPACES
from tidemark.plans.inputs import TABLES, VIEWS, _needs
from tidemark.plans.queries import CSV_COLUMNS, VECTOR_DIM
from tidemark.vocab import (
    CODE_EXTENSIONS,
    LOAD_SUFFIXES,
    NON_COLUMN_PREFIXES,
    PII_WORDS,
    SKIPPED_FOLDERS,
    SQL_KEYWORDS,
)


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _strip(expr: str) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"trim({expr}, {blanks})"


def _half_even(expr: str, digits: int) -> str:
    """Round the exact binary value of a double, ties to even (through exact decimals)."""
    return f"round_even({expr}, {digits})"


def _valid(name: str) -> str:
    return (
        f"(length({name}) BETWEEN 2 AND 64 AND regexp_full_match({name}, '[a-zA-Z_][a-zA-Z0-9_]*') "
        f"AND NOT list_contains({_texts(SQL_KEYWORDS)}, upper({name})))"
    )


def _pii(name: str) -> str:
    return f"list_sort(list_filter({_texts(PII_WORDS)}, lambda w: contains(lower({name}), w)))"


def _slo_ok(actual: str, expected: str) -> str:
    return f"CASE WHEN {actual} <> 0 AND {expected} <> 0 THEN {actual} <= {expected} * 1.1 ELSE TRUE END"


V: dict[str, str] = dict(VIEWS)

# -- corpus ------------------------------------------------------------------------------

V["all_paths"] = f"""
SELECT *, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1)) AS ext,
  list_contains({_texts(CODE_EXTENSIONS)}, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1)))
  AND NOT list_has_any(string_split(path, '/')[:-2], {_texts(SKIPPED_FOLDERS)}) AS eligible
FROM {{code_files}}
"""
V["corpus"] = f"""
SELECT file_ord, path, content, ext FROM {{all_paths}} WHERE eligible AND {_strip('content')} <> ''
"""
V["py_texts"] = """
SELECT file_ord, path, regexp_extract_all(content, '(?s)(?:\"\"\"|'''''')(.*?)(?:\"\"\"|'''''')', 1) AS t
FROM {corpus} WHERE ext = '.py'
"""
V["sql_texts"] = """
SELECT file_ord, path, 0 AS text_ord, content AS sql FROM {corpus} WHERE ext = '.sql'
UNION ALL
SELECT * FROM (SELECT file_ord, path, unnest(range(len(t)))::INT AS text_ord, unnest(t) AS sql FROM {py_texts})
WHERE regexp_matches(sql, '(?i)\\b(SELECT|INSERT|CREATE|UPDATE|DELETE)\\b')
"""
_BLOCK = (
    "(?is)CREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:TEMPORARY\\s+)?TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?"
    "(?:\\w+\\.)?[\"`\\[]?(\\w+)[\"`\\]]?\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)"
)
V["blocks"] = f"""
SELECT * FROM (
  SELECT file_ord, path, text_ord, unnest(range(len(n)))::INT AS block_ord, unnest(n) AS name, unnest(b) AS body
  FROM (SELECT *, regexp_extract_all(sql, '{_BLOCK}', 1) AS n, regexp_extract_all(sql, '{_BLOCK}', 2) AS b FROM {{sql_texts}}))
WHERE {_valid('name')}
"""
_SKIP = " OR ".join(f"starts_with(upper(item), '{p}')" for p in NON_COLUMN_PREFIXES)
V["items"] = """
SELECT file_ord, path, text_ord, block_ord, name, unnest(range(len(parts)))::INT AS item_ord, trim(unnest(parts)) AS item
FROM (SELECT *, string_split(regexp_replace(body, '\\([^()]*\\)', '', 'g'), ',') AS parts FROM {blocks})
"""
V["block_columns"] = f"""
SELECT file_ord, path, text_ord, block_ord, name,
       (row_number() OVER (PARTITION BY file_ord, text_ord, block_ord ORDER BY item_ord) - 1)::INT AS pos, col AS "column"
FROM (SELECT *, regexp_extract(item, '^[^\\s]*') AS tok,
             regexp_replace(regexp_extract(item, '^[^\\s]*'), '[`"\\[\\]]', '', 'g') AS col
      FROM {{items}} WHERE NOT ({_SKIP}))
WHERE regexp_matches(col, '^[a-zA-Z_]')
  AND (regexp_matches(tok, '^[`"\\[]') OR NOT list_contains({_texts(SQL_KEYWORDS)}, upper(col)))
"""
V["definitions"] = """
SELECT b.file_ord, b.path, b.text_ord, b.block_ord, b.name,
       coalesce(list(c."column" ORDER BY c.pos) FILTER (WHERE c."column" IS NOT NULL), []) AS columns
FROM {blocks} b LEFT JOIN {block_columns} c USING (file_ord, path, text_ord, block_ord, name)
GROUP BY ALL
"""
V["file_definitions"] = """
SELECT name, file_ord, path, columns,
       first_value(text_ord) OVER w AS text_ord, first_value(block_ord) OVER w AS block_ord,
       row_number() OVER (PARTITION BY name, file_ord ORDER BY text_ord DESC, block_ord DESC) AS back
FROM {definitions} WINDOW w AS (PARTITION BY name, file_ord ORDER BY text_ord, block_ord)
"""
V["catalog"] = f"""
SELECT d.name, d.columns, d.path AS source_file, o.file_ord, o.text_ord, o.block_ord,
       list_filter(d.columns, lambda c: len({_pii('c')}) > 0) AS pii_names
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len(columns) DESC, file_ord) AS best
      FROM {{file_definitions}} WHERE back = 1 AND len(columns) > 0) d
JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_ord) AS first
      FROM {{file_definitions}} WHERE back = 1 AND len(columns) > 0) o
  ON o.name = d.name AND o.first = 1
WHERE d.best = 1
"""
V["insert_parts"] = """
SELECT file_ord, path, text_ord, unnest(range(len(parts)))::INT AS block_ord, unnest(parts) AS block
FROM (SELECT *, string_split(ltrim(regexp_replace(sql, '(?i)(INSERT\\s+(?:OR\\s+\\w+\\s+)?INTO\\s)', chr(1) || '\\1', 'g'), chr(1)), chr(1)) AS parts
      FROM {sql_texts})
"""
_INTO = "^(?is)INSERT\\s+(?:OR\\s+\\w+\\s+)?INTO\\s+(?:\\w+\\.)?(\\w+)\\b(.*)"
V["insert_statements"] = f"""
SELECT file_ord, 0 AS part, path, text_ord, block_ord, target,
       CASE WHEN picked <> '' THEN picked ELSE rest END AS body
FROM (SELECT *, regexp_extract(rest, '(?is)\\bSELECT\\b.*?(?:;|$)') AS picked FROM (
  SELECT *, regexp_extract(block, '{_INTO}', 1) AS target, regexp_extract(block, '{_INTO}', 2) AS rest FROM {{insert_parts}}))
WHERE {_valid('target')}
"""
_ASSIGNED = "(?s)(\\w+)\\s*=\\s*\\(?\\s*(?:\"\"\"|'''''')(.*?)(?:\"\"\"|'''''')\\s*\\)?"
V["variable_statements"] = f"""
SELECT file_ord, 1 AS part, path, text_ord, 0 AS block_ord,
       regexp_replace(var, '(?:{"|".join(LOAD_SUFFIXES)})$', '') AS target, body
FROM (SELECT file_ord, path, unnest(range(len(n)))::INT AS text_ord, lower(unnest(n)) AS var, unnest(b) AS body
      FROM (SELECT *, regexp_extract_all(content, '{_ASSIGNED}', 1) AS n, regexp_extract_all(content, '{_ASSIGNED}', 2) AS b
            FROM {{corpus}} WHERE ext = '.py'))
WHERE regexp_matches(var, '_insert|_load|_upsert') AND regexp_matches(body, '(?i)\\bSELECT\\b')
"""


def _edges(statements: str, pattern: str) -> str:
    return f"""
SELECT file_ord, part, text_ord, block_ord, src_ord, source, target,
       CASE WHEN list_contains(joined, lower(source)) THEN 'JOIN' ELSE 'INSERT_SELECT' END AS transformation, path AS file
FROM (SELECT file_ord, part, text_ord, block_ord, path, target,
             unnest(range(len(s)))::INT AS src_ord, unnest(s) AS source, joined
      FROM (SELECT *, regexp_extract_all(body, '{pattern}', 1) AS s,
                   list_transform(regexp_extract_all(body, '(?i)\\bJOIN\\s+(?:\\w+\\.)?(\\w+)', 1), lambda x: lower(x)) AS joined
            FROM {{{statements}}}))
WHERE {_valid('source')} AND lower(source) <> lower(target)
"""


V["insert_edges"] = _edges("insert_statements", "(?i)(?:FROM|JOIN)\\s+(?:\\w+\\.)?(\\w+)")
V["variable_edges"] = _edges(
    "variable_statements", "(?i)(?:FROM|JOIN)\\s+\\(?(?:\\w+\\.)?(\\w+)(?:\\s+(?:AS\\s+)?\\w+)?"
)
V["raw_edges"] = "SELECT * FROM {insert_edges} UNION ALL SELECT * FROM {variable_edges}"
V["edge_names"] = """
SELECT DISTINCT lower(n) AS name FROM (SELECT source AS n FROM {raw_edges} UNION ALL SELECT target FROM {raw_edges})
"""
V["resolved"] = """
SELECT name, resolved FROM (
  SELECT e.name, c.name AS resolved, row_number() OVER (PARTITION BY e.name ORDER BY
     CASE WHEN lower(c.name) IN (e.name, e.name || 's', e.name || 'es') THEN 1 ELSE 2 END, c.file_ord, c.text_ord, c.block_ord) AS place
  FROM {edge_names} e JOIN {catalog} c
    ON lower(c.name) IN (e.name, e.name || 's', e.name || 'es') OR starts_with(lower(c.name), e.name))
WHERE place = 1
"""
V["lineage"] = f"""
SELECT source, target, transformation, file FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target)
                               ORDER BY file_ord, part, text_ord, block_ord, src_ord) AS place
  FROM (SELECT coalesce(a.resolved, e.source) AS source, coalesce(b.resolved, e.target) AS target,
               transformation, file, file_ord, part, text_ord, block_ord, src_ord
        FROM {{raw_edges}} e LEFT JOIN {{resolved}} a ON a.name = lower(e.source)
        LEFT JOIN {{resolved}} b ON b.name = lower(e.target))
  WHERE lower(source) <> lower(target) AND {_valid('source')} AND {_valid('target')})
WHERE place = 1
"""
V["nodes"] = """
SELECT source AS id FROM {lineage} UNION SELECT target FROM {lineage}
UNION SELECT name FROM {catalog} WHERE len(columns) > 0
"""
V["degrees"] = """
SELECT n.id, (SELECT count(*) FROM {lineage} e WHERE e.target = n.id) AS in_degree,
       (SELECT count(*) FROM {lineage} e WHERE e.source = n.id) AS out_degree
FROM {nodes} n
"""
_DAGGY = "(?i)(from\\s+airflow|import\\s+airflow|DAG\\s*\\(|@dag\\b|airflow\\.DAG)"
V["dag_texts"] = f"SELECT * FROM {{corpus}} WHERE ext = '.py' AND regexp_matches(content, '{_DAGGY}')"
V["dags"] = """
SELECT file_ord, path AS source_file, 0 AS dag_ord, regexp_extract(content, 'DAG\\s*\\(\\s*["'']([^"'']+)["'']', 1) AS dag_id,
       regexp_extract(content, 'schedule_interval\\s*=\\s*["'']([^"'']+)["'']', 1) AS schedule,
       regexp_extract_all(content, 'task_id\\s*=\\s*["'']([^"'']+)["'']', 1) AS tasks,
       regexp_extract_all(content, '["'']owner["'']\\s*:\\s*["'']([^"'']+)["'']', 1) AS owners,
       regexp_extract_all(regexp_extract(content, 'tags\\s*=\\s*\\[([^\\]]+)\\]', 1), '["'']([^"'']+)["'']', 1)[:2] AS tags,
       NOT contains(content, 'def (:') AS by_syntax
FROM {dag_texts}
"""
V["registry"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY file_ord DESC) AS back FROM {dags}) WHERE back = 1
"""

# -- health ---------------------------------------------------------------------------------

_OBSERVED = """
SELECT dag_id, max_by(status, (ts, run_id)) AS status, max(ts) AS last_run,
       max_by(duration_s, (ts, run_id)) AS duration_actual,
       count(*) FILTER (WHERE status = 'failed') AS failure_count, count(*) AS run_count,
       max_by(error, (ts, run_id)) AS last_error
FROM {source} GROUP BY dag_id
"""
V["observed"] = _OBSERVED.replace("{source}", "{run_log}")
V["targets"] = "SELECT *, greatest(60.0, 30.0 + n_tasks * 20.0)::DOUBLE AS target FROM {dag_registry}"
V["pipelines"] = f"""
SELECT o.*, t.target AS duration_expected, t.dag_id IS NOT NULL AS is_real,
       {_slo_ok('duration_actual', 't.target')} AS slo_ok,
       {_half_even('(run_count - failure_count) / greatest(run_count, 1) * 100', 1)} AS success_rate,
       round(least(100.0, coalesce(t.target, 0) / greatest(coalesce(duration_actual, 0), 1.0) * 100), 6) AS slo_bar,
       t.dag_id IS NOT NULL AS rich, t.schedule, t.n_tasks, t.owner, t.source_file
FROM {{observed}} o LEFT JOIN {{targets}} t ON t.dag_id = o.dag_id
"""

# -- cells -------------------------------------------------------------------------------------

V["cells"] = "\nUNION ALL\n".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\", coalesce({c}, '') AS value FROM {{raw_csv}}" for i, c in enumerate(CSV_COLUMNS)
)
V["classes"] = f"""
SELECT *, CASE WHEN {_strip('value')} = '' THEN NULL
  WHEN regexp_matches(value, '^\\s*[+-]?\\d+(_\\d+)*\\s*$') THEN 'int'
  WHEN regexp_matches(value, '^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|(?i)inf(inity)?|(?i)nan)\\s*$') THEN 'float'
  WHEN try_strptime(trim(value), ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%dT%H:%M:%S']) IS NOT NULL THEN 'date'
  ELSE 'text' END AS kind
FROM {{cells}}
"""
V["column_types"] = """
SELECT *, CASE WHEN filled = 0 THEN 'unknown' WHEN dates / filled > 0.7 THEN 'date' WHEN ints / filled > 0.8 THEN 'integer'
              WHEN (ints + floats) / filled > 0.7 THEN 'float' ELSE 'string' END AS inferred_type
FROM (SELECT pos, "column", count(*) AS rows, count(kind) AS filled, count(*) FILTER (WHERE kind = 'int') AS ints,
             count(*) FILTER (WHERE kind = 'float') AS floats, count(*) FILTER (WHERE kind = 'date') AS dates,
             count(DISTINCT value) FILTER (WHERE kind IS NOT NULL) AS unique_count
      FROM {classes} GROUP BY pos, "column")
"""
V["profiled"] = f"""
SELECT *, rows - filled AS null_count, {_half_even('(rows - filled) / rows * 100', 2)} AS null_pct,
       CASE WHEN inferred_type IN ('integer', 'float') THEN filled - ints - floats ELSE 0 END AS type_mismatches,
       len({_pii('"column"')}) > 0 AS is_pii
FROM {{column_types}}
"""
V["duplicates"] = f"""
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CSV_COLUMNS)} FROM {{raw_csv}})) AS duplicate_rows
FROM {{raw_csv}}
"""
V["quality"] = f"""
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Needs attention' ELSE 'Poor quality' END AS quality_band
FROM (SELECT *, {_half_even('''greatest(0.0, 1 - total_nulls / (total_rows * total_columns) - duplicate_rows / total_rows
        - total_mismatches / (total_rows * total_columns)) * 100''', 2)} AS quality_score
  FROM (SELECT count(*) AS total_columns, sum(null_count)::BIGINT AS total_nulls, sum(type_mismatches)::BIGINT AS total_mismatches
        FROM {{profiled}}), {{duplicates}})
"""

# -- chunks and vectors ------------------------------------------------------------------------


def _chunks(files: str) -> str:
    """Line by line: a chunk ends with the line that brings its characters to 400."""
    return f"""
SELECT file, chunk, type, text, md5(file || ':' || chunk) AS id FROM (
  SELECT path AS file, chunk, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text,
         CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.sql') THEN 'sql'
              WHEN ends_with(path, '.yml') OR ends_with(path, '.yaml') THEN 'yaml'
              WHEN ends_with(path, '.md') THEN 'markdown' ELSE 'text' END AS type
  FROM (
    WITH RECURSIVE lines AS (
      SELECT path, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
      FROM (SELECT path, string_split(content, chr(10)) AS l FROM {{{files}}} WHERE {_strip('content')} <> '')),
    walk AS (
      SELECT path, i, line, 0 AS chunk, length(line) AS filled FROM lines WHERE i = 1
      UNION ALL
      SELECT n.path, n.i, n.line, CASE WHEN w.filled >= 400 THEN w.chunk + 1 ELSE w.chunk END,
             CASE WHEN w.filled >= 400 THEN length(n.line) ELSE w.filled + length(n.line) END
      FROM walk w JOIN lines n ON n.path = w.path AND n.i = w.i + 1)
    SELECT * FROM walk)
  GROUP BY path, chunk)
WHERE text <> ''
"""


V["chunks"] = _chunks("text_files")
V["page_files"] = "SELECT url AS path, html AS content FROM {pages}"
V["page_chunks"] = _chunks("page_files")
V["code_chunks"] = _chunks("corpus")
V["changed_files"] = (
    "SELECT path, CASE WHEN starts_with(path, 'docs/src1/') THEN reverse(content) ELSE content END AS content "
    "FROM {text_files}"
)
V["changed_chunks"] = _chunks("changed_files")


def _slots(source: str, key: str) -> str:
    return f"""
SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {VECTOR_DIM} AS slot, count(*) AS n
FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+')) AS word FROM {{{source}}})
GROUP BY 1, 2
"""


V["chunk_slots"] = _slots("chunks", "id")
V["idf"] = f"""
SELECT slot, ln((1 + (SELECT count(*) FROM {{chunks}})) / (1 + count(s.id))) AS idf
FROM range({VECTOR_DIM}) r(slot) LEFT JOIN {{chunk_slots}} s USING (slot) GROUP BY slot
"""


def _weights(slots: str, key: str) -> str:
    return f"""
SELECT {key}, slot, (w / sqrt(sum(w * w) OVER (PARTITION BY {key})))::FLOAT AS weight
FROM (SELECT {key}, slot, n * idf AS w FROM {{{slots}}} JOIN {{idf}} USING (slot)) WHERE w <> 0
"""


V["chunk_weights"] = _weights("chunk_slots", "id")
V["asked"] = """
SELECT conv_id AS query_id, max(turn) AS asked, max_by(text, turn) AS text
FROM {conversations} WHERE role = 'user' GROUP BY conv_id
"""
V["query_slots"] = _slots("asked", "query_id")
V["query_weights"] = _weights("query_slots", "query_id")
V["hits"] = """
SELECT * FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.query_id, c.id, round(sum(q.weight::DOUBLE * c.weight) / (sqrt(any_value(q.len)) * sqrt(any_value(c.len))), 9) AS score
        FROM (SELECT *, sum(weight::DOUBLE * weight) OVER (PARTITION BY query_id) AS len FROM {query_weights}) q
        JOIN (SELECT *, sum(weight::DOUBLE * weight) OVER (PARTITION BY id) AS len FROM {chunk_weights}) c USING (slot)
        GROUP BY 1, 2))
WHERE rank <= 5
"""
V["contexts"] = """
SELECT query_id, string_agg('[' || file || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM {hits} JOIN {chunks} USING (id) WHERE rank <= 3 GROUP BY query_id
"""


def _tails(turns: str) -> str:
    return f"""
SELECT conv_id, string_agg(chr(10) || upper(role) || ': ' || text, '' ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {{{turns}}})
WHERE back <= 4 GROUP BY conv_id
"""


V["earlier_turns"] = """
SELECT c.* FROM {conversations} c JOIN {asked} a ON a.query_id = c.conv_id AND c.turn < a.asked
"""
V["earlier_tails"] = _tails("earlier_turns")
V["snapshots"] = """
SELECT user_id AS run_id, ts, event_id AS seq, event_type AS stage, floor(value)::BIGINT AS current,
       event_id % 120 AS total, props AS message, event_type = 'purchase' AS done FROM {events}
"""

_CHECK_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "filled_csv": CSV_COLUMNS,
}
V["filled_csv"] = "SELECT " + ", ".join(
    f"CASE WHEN {_strip(c)} <> '' THEN {c} END AS {c}" for c in CSV_COLUMNS
) + " FROM {raw_csv}"
_MISFITS = {
    "orders": [("o_totalprice", "DOUBLE"), ("o_orderpriority", "INT")],
    "customer": [],
    "filled_csv": [("id", "BIGINT"), ("amount", "DOUBLE"), ("qty", "INT"), ("order_date", "DATE")],
}


def _check(source: str, shown: str) -> str:
    columns = _CHECK_COLUMNS[source]
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    misfits = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL) > 0 THEN "
        f"'{c}:' || count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL) END"
        for c, t in _MISFITS[source]
    )
    listed = f"concat_ws(',', {misfits})" if misfits else "''"
    return f"""
SELECT '{shown}' AS "table", total_rows, duplicate_rows, misfits,
       {_half_even(f'(1 - (nulls + duplicate_rows) / (total_rows * {len(columns)})) * 100', 2)} AS quality_score,
       nulls = 0 AND duplicate_rows = 0 AND misfits = '' AS passed
FROM (SELECT count(*) AS total_rows, {nulls} AS nulls, {listed} AS misfits,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {{{source}}})) AS duplicate_rows FROM {{{source}}})
"""


def _null_shares(source: str, shown: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{shown}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) / count(*), 6) AS null_share FROM {{{source}}}"
        for c in _CHECK_COLUMNS[source]
    )


_SHOWN = [("orders", "orders"), ("customer", "customer"), ("filled_csv", "raw_csv")]
_TOTALS = """
(SELECT count(*) FROM {catalog}) AS total_tables,
(SELECT count(*) FROM {catalog} WHERE len(pii_names) > 0) AS pii_tables,
(SELECT count(*) FROM {catalog} WHERE len(pii_names) = 0) AS clean_tables,
(SELECT count(*) FROM {nodes}) AS lineage_nodes, (SELECT count(*) FROM {lineage}) AS lineage_edges,
count(*) AS total_pipelines, count(*) FILTER (WHERE slo_ok) AS slo_passing,
count(*) FILTER (WHERE NOT slo_ok) AS slo_failing,
round_even(count(*) FILTER (WHERE slo_ok) / greatest(count(*), 1) * 100, 1) AS slo_percentage
"""
_LEVELS = """
(WITH RECURSIVE walk AS (
   SELECT id, 0 AS level FROM {degrees} WHERE in_degree = 0
   UNION SELECT e.target, w.level + 1 FROM walk w JOIN {lineage} e ON e.source = w.id)
 SELECT id, max(level)::INT AS level FROM walk GROUP BY id)
"""
_PII_SUMMARY = (
    "array_to_string(list_transform(pii_names, lambda c: c || '(' || array_to_string("
    + _pii("c")
    + ", '+') || ')'), ' | ')"
)
_ROUNDED_DURATION = "round(duration_actual, 6) AS duration_actual"

Q: dict[str, str] = {
    "a1_code_tree_scan": "SELECT path, content FROM {corpus}",
    "a2_delimited_scan": "SELECT " + ", ".join(f"trim({c}) AS {c}" for c in CSV_COLUMNS) + " FROM {raw_csv}",
    "a3_catalog_listing": "SELECT name, array_to_string(columns, ',') AS columns, len(pii_names)::INT AS n_pii, source_file, "
    "len(pii_names) > 0 AS has_pii FROM {catalog} ORDER BY name",
    "a4_full_refresh": "SELECT * FROM {lineage}",
    "a5_guarded_refresh": "SELECT dag_id, schedule, len(tasks)::INT AS n_tasks, source_file FROM {registry}",
    "a6_vector_upsert": "SELECT id, file, chunk, md5(text) AS text_md5 FROM {changed_chunks} UNION ALL "
    "SELECT id, file, chunk, md5(text) FROM {chunks} WHERE id NOT IN (SELECT id FROM {changed_chunks})",
    "a7_run_state": "SELECT user_id, max_by(props, (ts, event_id)) AS props FROM {events} GROUP BY user_id",
    "a8_json_report": """
SELECT 'meta' AS section, 1 AS entries UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'slo', 1
UNION ALL SELECT 'data_catalog', count(*) FROM {catalog}
UNION ALL SELECT 'pii_audit', count(*) FROM {catalog} WHERE len(pii_names) > 0
UNION ALL SELECT 'lineage_nodes', count(*) FROM {nodes}
UNION ALL SELECT 'lineage_edges', count(*) FROM {lineage}
UNION ALL SELECT 'critical_pipelines', count(*) FROM {pipelines} WHERE NOT slo_ok OR status = 'failed'
UNION ALL SELECT 'pipelines', count(*) FROM {pipelines}
""",
    "a9_csv_report": "SELECT name, CASE WHEN len(pii_names) > 0 THEN 'YES' ELSE 'NO' END AS has_pii, len(columns)::INT AS n_columns, "
    f"array_to_string(columns, ' | ') AS columns, {_PII_SUMMARY} AS pii FROM {{catalog}}",
    "a8_json_lineage": "SELECT source, target, transformation, file FROM {lineage} UNION ALL SELECT id, id, 'NODE', '' FROM {nodes}",
    "a9_csv_lineage": "SELECT * FROM {lineage}",
    "a9_csv_pii_audit": f"SELECT name AS \"table\", source_file, c AS \"column\", array_to_string({_pii('c')}, ', ') AS pii_types "
    "FROM (SELECT name, source_file, unnest(pii_names) AS c FROM {catalog})",
    "a9_csv_health": "SELECT dag_id, coalesce(status, '') AS status, CASE WHEN slo_ok THEN 'YES' ELSE 'NO' END AS slo_ok, "
    "success_rate::DOUBLE AS success_rate, failure_count::BIGINT AS failure_count, coalesce(last_error, '') AS last_error FROM {pipelines}",
    "a9_csv_summary": f"""
SELECT unnest(['Total Tables', 'PII Tables', 'Clean Tables', 'Lineage Edges', 'Total Pipelines', 'SLO Passing', 'SLO Failing']) AS metric,
       unnest([total_tables, pii_tables, clean_tables, lineage_edges, total_pipelines, slo_passing, slo_failing])::VARCHAR AS value
FROM (SELECT {_TOTALS} FROM {{pipelines}})
""",
    "a10_preview": "SELECT row_id, unnest([" + ", ".join(f"'{c}'" for c in CSV_COLUMNS) + '])'
    + ' AS "column", unnest([' + ", ".join(CSV_COLUMNS)
    + "]) AS value FROM (SELECT * FROM {raw_csv} ORDER BY row_id LIMIT 10)",
    "b1_file_type": "SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.sql') THEN 'sql' "
    "WHEN ends_with(path, '.yml') OR ends_with(path, '.yaml') THEN 'yaml' WHEN ends_with(path, '.md') THEN 'markdown' "
    "ELSE 'text' END AS type FROM {code_files}",
    "b2_code_paths": "SELECT path, eligible FROM {all_paths}",
    "b3_nonblank_files": "SELECT path, length(content)::INT AS n_chars FROM (SELECT path, content FROM {code_files} UNION ALL "
    f"SELECT path, content FROM {{text_files}}) WHERE {_strip('content')} <> ''",
    "b7_catalog_search": "SELECT name FROM {catalog} WHERE contains(lower(name), 'address') OR contains(lower(source_file), 'address') "
    "OR len(list_filter(columns, lambda c: contains(lower(c), 'address'))) > 0",
    "b8_catalog_categories": "SELECT name, 'all' AS category FROM {catalog} UNION ALL SELECT name, 'rich' FROM {catalog} WHERE len(columns) > 0 "
    "UNION ALL SELECT name, CASE WHEN len(pii_names) > 0 THEN 'pii' ELSE 'clean' END FROM {catalog}",
    "b9_health_categories": "SELECT dag_id, 'all' AS category FROM {pipelines} UNION ALL SELECT dag_id, 'failed' FROM {pipelines} WHERE status = 'failed' "
    "UNION ALL SELECT dag_id, 'slo' FROM {pipelines} WHERE NOT slo_ok UNION ALL SELECT dag_id, 'ok' FROM {pipelines} WHERE status = 'success' AND slo_ok "
    "UNION ALL SELECT dag_id, 'real' FROM {pipelines} WHERE is_real",
    "b10_b11_b12_display_strings": "SELECT name, string_split(source_file, '/')[-1] AS file, array_to_string(columns[:6], ', ') || "
    "CASE WHEN len(columns) > 6 THEN ' +' || (len(columns) - 6) || ' more' ELSE '' END AS preview, "
    f"{_PII_SUMMARY} AS pii FROM {{catalog}}",
    "b13_expected_duration": "SELECT dag_id, target AS expected_s FROM {targets}",
    "b14_b15_b16_b17_health_scores": "SELECT dag_id, slo_ok, success_rate, slo_bar, rich FROM {pipelines}",
    "b18_score_bands": "SELECT dag_id AS item, CASE WHEN success_rate >= 90 THEN 'Excellent' WHEN success_rate >= 70 THEN 'Needs attention' "
    "ELSE 'Poor quality' END AS band FROM {pipelines} UNION ALL SELECT \"column\", CASE WHEN null_pct > 10 THEN 'high' "
    "WHEN null_pct > 5 THEN 'medium' ELSE 'low' END FROM {profiled}",
    "b19_chunk_ids": "SELECT file, chunk, id FROM {chunks}",
    "b20_progress_percent": "SELECT seq, trunc(current / greatest(total, 1) * 100)::BIGINT AS pct FROM {snapshots}",
    "b21_b22_workflow_defaults": "SELECT source_file, dag_id, schedule, array_to_string(tags, ',') AS tags, array_to_string(owners, ',') AS owners, "
    "'' AS description, FALSE AS catchup, 1::BIGINT AS max_active_runs FROM {dags}",
    "c1_embedded_sql": "SELECT path, text_ord, md5(sql) AS sql_md5 FROM {sql_texts}",
    "c2_create_table_blocks": "SELECT path, text_ord, block_ord, name, md5(body) AS body_md5 FROM {blocks}",
    "c3_columns": 'SELECT path, text_ord, block_ord, name, pos, "column" FROM {block_columns}',
    "c4_insert_edges": "SELECT * FROM {insert_edges}",
    "c5_variable_edges": "SELECT * FROM {variable_edges}",
    "c6_workflow_files": "SELECT path FROM {dag_texts}",
    "c7_workflow_definitions": "SELECT source_file, dag_ord, dag_id, schedule, array_to_string(tasks, ',') AS tasks, "
    "array_to_string(owners, ',') AS owners, by_syntax FROM {dags}",
    "c8_pattern_definitions": "SELECT source_file, dag_id, schedule, array_to_string(tasks, ',') AS tasks, "
    "array_to_string(owners, ',') AS owners, array_to_string(tags, ',') AS tags FROM {dags}",
    "c9_tasks": "SELECT source_file, dag_ord, unnest(range(len(tasks)))::INT AS pos, unnest(tasks) AS task_id FROM {dags}",
    "c10_exploded_lists": " UNION ALL ".join(
        f"SELECT dag_id, unnest(range(len({c})))::INT AS pos, unnest({c}) AS item, '{c}' AS list FROM {{registry}}"
        for c in ("owners", "tags", "tasks")
    ),
    "d1_line_chunks": "SELECT file, chunk, type, md5(text) AS text_md5 FROM {chunks}",
    "d1_markup_chunks": "SELECT file, chunk, md5(text) AS text_md5 FROM {page_chunks}",
    "d2_chunk_vectors": "SELECT id, slot::INT AS slot, round(weight::DOUBLE, 4) AS weight FROM {chunk_weights}",
    "d5_store_count": "SELECT count(*) AS rows FROM {chunks}",
    "d6_contexts": "SELECT query_id, md5(context) AS context_md5 FROM {contexts}",
    "d7_history_tails": _tails("conversations"),
    "d8_prompts": """
SELECT a.query_id AS conv_id, CASE WHEN c.context IS NULL THEN '' ELSE 'RELEVANT CODEBASE CONTEXT:' || chr(10) || c.context || chr(10) || chr(10) END
  || CASE WHEN t.history IS NULL THEN '' ELSE 'CONVERSATION HISTORY:' || t.history || chr(10) || chr(10) END
  || 'USER: ' || a.text || chr(10) || chr(10) || 'A:' AS prompt
FROM {asked} a LEFT JOIN {contexts} c USING (query_id) LEFT JOIN {earlier_tails} t ON t.conv_id = a.query_id
""",
    "d9_sources": "SELECT query_id, rank::INT AS rank, file, type FROM {hits} JOIN {chunks} USING (id)",
    "e1_resolved_names": "SELECT * FROM {resolved}",
    "e2_enriched_health": f"SELECT dag_id, status, last_run, {_ROUNDED_DURATION}, duration_expected, failure_count, run_count, last_error, "
    "is_real, schedule, CASE WHEN is_real THEN array_to_string(list_transform(range(1, n_tasks + 1), lambda i: 'task_' || i), ',') END AS tasks, "
    "owner AS owners, source_file FROM {pipelines}",
    "e3_health_sync": f"""
SELECT coalesce(o.dag_id, t.dag_id) AS dag_id,
       CASE WHEN o.dag_id IS NOT NULL THEN o.status ELSE r.status END AS status,
       CASE WHEN o.dag_id IS NOT NULL THEN o.last_run ELSE r.last_run END AS last_run,
       round(CASE WHEN o.dag_id IS NOT NULL THEN o.duration_actual ELSE r.duration_actual END, 6) AS duration_actual,
       coalesce(t.target, 100.0) AS duration_expected,
       coalesce(CASE WHEN o.dag_id IS NOT NULL THEN o.failure_count ELSE r.failure_count END, 0) AS failure_count,
       coalesce(CASE WHEN o.dag_id IS NOT NULL THEN o.run_count ELSE r.run_count END, 0) AS run_count,
       coalesce(CASE WHEN o.dag_id IS NOT NULL THEN o.last_error ELSE r.last_error END, '') AS last_error,
       TRUE AS is_real
FROM (SELECT * FROM ({_OBSERVED.replace("{source}", "(SELECT * FROM {run_log} WHERE status <> 'running')")}) WHERE status = 'success') o
FULL JOIN {{targets}} t ON t.dag_id = o.dag_id
LEFT JOIN {{observed}} r ON r.dag_id = coalesce(o.dag_id, t.dag_id)
""",
    "e4_column_tags": "SELECT name, unnest(range(len(columns)))::INT AS pos, unnest(columns) AS \"column\", "
    f"unnest(list_transform(columns, lambda c: CASE WHEN len({_pii('c')}) > 0 THEN array_to_string({_pii('c')}, '+') END)) AS pii_types FROM {{catalog}}",
    "e5_neighbours": "SELECT target AS id, 'upstream' AS direction, source AS neighbour FROM {lineage} UNION ALL "
    "SELECT source, 'downstream', target FROM {lineage} UNION ALL "
    "SELECT id, 'isolated', NULL FROM {nodes} WHERE id NOT IN (SELECT source FROM {lineage} UNION SELECT target FROM {lineage})",
    "e6_table_workflows": "SELECT DISTINCT t.name AS \"table\", r.dag_id FROM (SELECT source AS name, file FROM {lineage} UNION SELECT target, file FROM {lineage}) t "
    "JOIN {registry} r ON r.source_file = t.file",
    "e7_workflow_owners": "SELECT dag_id, status, owner FROM {pipelines}",
    "e8_catalog_lookup": "SELECT name, unnest(range(len(columns)))::INT AS pos, unnest(columns) AS \"column\" FROM {catalog} WHERE name = 'stg_0'",
    "f1_observed_runs": f"SELECT dag_id, status, last_run, {_ROUNDED_DURATION}, failure_count, run_count, last_error FROM {{observed}}",
    "f2_slo_summary": """
SELECT *, CASE WHEN slo_percentage >= 90 THEN 'Excellent' WHEN slo_percentage >= 70 THEN 'Needs attention' ELSE 'Poor quality' END AS slo_band
FROM (SELECT count(*) AS total_pipelines, count(*) FILTER (WHERE slo_ok) AS slo_passing, count(*) FILTER (WHERE NOT slo_ok) AS slo_failing,
             round_even(count(*) FILTER (WHERE slo_ok) / greatest(count(*), 1) * 100, 1) AS slo_percentage,
             count(*) FILTER (WHERE is_real) AS real_dag_count, count(*) FILTER (WHERE is_real) > 0 AS has_real_data FROM {pipelines})
""",
    "f3_critical_dags": "SELECT dag_id, status, slo_ok FROM {pipelines} WHERE NOT slo_ok OR status = 'failed'",
    "f4_null_profile": 'SELECT pos, "column", rows, null_count, null_pct FROM {profiled}',
    "f5_distinct_profile": f"SELECT pos, \"column\", rows, unique_count, {_half_even('unique_count / rows * 100', 2)} AS unique_pct FROM {{profiled}}",
    "f6_f7_types": 'SELECT pos, "column", filled, ints, floats, dates, inferred_type, type_mismatches FROM {profiled}',
    "f8_numeric_stats": """
SELECT "column" AS name, round(min(v), 2) AS min, round(max(v), 2) AS max, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std,
       round(list_sort(list(v))[count(*) // 2 + 1], 2) AS median
FROM (SELECT c."column", c.value::DOUBLE AS v FROM {classes} c JOIN {profiled} p USING (pos)
      WHERE c.kind IN ('int', 'float') AND p.inferred_type IN ('integer', 'float'))
GROUP BY 1
""",
    "f8_lineitem_medians": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", list_sort(list({c}))[count(*) // 2 + 1] AS median FROM {{lineitem}}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "f9_duplicate_rows": "SELECT * FROM {duplicates}",
    "f10_quality_score": "SELECT * FROM {quality}",
    "f11_issues": """
SELECT 1 AS place, 'warning' AS severity, 'High null rate (>5%) in: ' || string_agg("column", ', ' ORDER BY pos) AS message
FROM {profiled} WHERE null_pct > 5 HAVING count(*) > 0
UNION ALL SELECT 2, CASE WHEN duplicate_rows > total_rows * 0.01 THEN 'error' ELSE 'warning' END, duplicate_rows || ' duplicate rows detected'
FROM {quality} WHERE duplicate_rows > 0
UNION ALL SELECT 3, 'warning', 'Type mismatches in ''' || "column" || ''': ' || type_mismatches || ' non-' || inferred_type || ' values'
FROM {profiled} WHERE type_mismatches > 0
UNION ALL SELECT 4, 'info', 'PII detected in: ' || string_agg("column", ', ' ORDER BY pos) FROM {profiled} WHERE is_pii HAVING count(*) > 0
UNION ALL SELECT 5, 'success', 'Data quality looks excellent!' FROM {quality} WHERE quality_score >= 95
""",
    "f12_quality_checks": " UNION ALL ".join(_check(*s) for s in _SHOWN),
    "f13_check_totals": " UNION ALL ".join(_null_shares(*s) for s in _SHOWN),
    "f14_catalog_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE len(pii_names) > 0) AS pii, count(*) FILTER (WHERE len(pii_names) = 0) AS clean, "
    "count(*) FILTER (WHERE len(columns) > 0) AS with_columns FROM {catalog}",
    "f15_report_summary": f"SELECT {_TOTALS} FROM {{pipelines}}",
    "f16_pii_audit": f"SELECT name AS \"table\", source_file, c AS \"column\", array_to_string({_pii('c')}, ', ') AS pii_types "
    "FROM (SELECT name, source_file, unnest(pii_names) AS c FROM {catalog})",
    "f16_pii_totals": "SELECT sum(len(pii_names))::BIGINT AS pii_columns, count(*) FILTER (WHERE len(pii_names) > 0) AS pii_tables FROM {catalog}",
    "f17_ingest_summary": "SELECT (SELECT count(*) FROM {corpus}) AS files_processed, (SELECT count(*) FROM {code_chunks}) AS chunks_indexed, "
    "(SELECT count(*) FROM {catalog}) AS tables_found, (SELECT count(*) FROM {lineage}) AS lineage_edges, (SELECT count(*) FROM {dags}) AS dags_found, "
    "0::BIGINT AS files_skipped",  # no file of the view is nested too deeply
    "f18_graph_size": "SELECT (SELECT count(*) FROM {nodes}) AS nodes, (SELECT count(*) FROM {lineage}) AS edges",
    "f19_level_sizes": f"SELECT level, count(*) AS nodes FROM {_LEVELS} GROUP BY level",
    "f19_largest_level": f"SELECT max(nodes) AS largest FROM (SELECT level, count(*) AS nodes FROM {_LEVELS} GROUP BY level)",
    "g1_merged_definitions": "SELECT name, array_to_string(columns, ',') AS columns, source_file, file_ord, text_ord, block_ord FROM {catalog}",
    "g2_merged_edges": "SELECT * FROM {lineage}",
    "g3_last_registry_rows": "SELECT dag_id, source_file, array_to_string(tasks, ',') AS tasks, array_to_string(owners, ',') AS owners FROM {registry}",
    "g4_recent_checks": "SELECT user_id, place::INT AS place, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place "
    "FROM {events}) WHERE place <= 10",
    "g5_ordered_listing": "SELECT dag_id, status, run_count FROM {pipelines} ORDER BY dag_id",
    "h1_node_set": "SELECT id, id AS label FROM {nodes} ORDER BY id",
    "h2_corpus_union": "SELECT file AS path, 'edge' AS kind, count(*) AS found FROM {raw_edges} GROUP BY 1 UNION ALL "
    "SELECT path, 'definition', count(*) FROM {definitions} GROUP BY 1 UNION ALL SELECT source_file, 'dag', count(*) FROM {dags} GROUP BY 1 UNION ALL "
    "SELECT file, 'chunk', count(*) FROM {code_chunks} GROUP BY 1",
    "h3_node_roles": "SELECT id, CASE WHEN in_degree = 0 THEN 'source' WHEN out_degree = 0 THEN 'sink' ELSE 'intermediate' END AS role FROM {degrees}",
    "h4_levels": f"SELECT id, level, in_degree FROM {_LEVELS} JOIN {{degrees}} USING (id)",
    "h5_upstream": """
SELECT start, id, min(steps)::INT AS steps FROM (
  WITH RECURSIVE walk AS (
    SELECT 'rpt_30' AS start, 'rpt_30' AS id, 0 AS steps
    UNION SELECT w.start, e.source, w.steps + 1 FROM walk w JOIN {lineage} e ON e.target = w.id)
  SELECT * FROM walk) WHERE steps > 0 GROUP BY start, id
""",
    "h5_downstream": """
SELECT start, id, min(steps)::INT AS steps FROM (
  WITH RECURSIVE walk AS (
    SELECT 'raw_hub' AS start, 'raw_hub' AS id, 0 AS steps
    UNION SELECT w.start, e.target, w.steps + 1 FROM walk w JOIN {lineage} e ON e.source = w.id)
  SELECT * FROM walk) WHERE steps > 0 GROUP BY start, id
""",
    "h6_failing": "SELECT dag_id, last_run, last_error FROM {pipelines} WHERE status = 'failed'",
    "h6_failing_on_day": "SELECT dag_id, last_run, last_error FROM {pipelines} WHERE status = 'failed' "
    "AND last_run::DATE = (SELECT max(ts)::DATE FROM {events})",
    "k3_stream_chunks": "SELECT id, file, chunk, md5(text) AS text_md5 FROM {chunks}",
}

_WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(content, '\\w+')) AS word FROM {code_files})"
Q["b4_table_names"] = f"SELECT word, {_valid('word')} AS valid FROM {_WORDS}"
Q["b5_pii_types"] = f"SELECT word, array_to_string({_pii('word')}, '+') AS types FROM {_WORDS}"
Q["b6_pii_flag"] = f"SELECT word, len({_pii('word')}) > 0 AS is_pii FROM {_WORDS}"

_CENTROIDS = """(SELECT label AS query_id, list(mean ORDER BY i) AS embedding FROM (
  SELECT label, i, avg(x) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM {embeddings})
  GROUP BY label, i) GROUP BY label)"""
_COSINES = """
SELECT query_id, rank::INT AS rank, id, round(round(score, 9), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT q.query_id, s.vec_id AS id, list_cosine_similarity(q.embedding, s.embedding::DOUBLE[]) AS score
        FROM %s q, {embeddings} s%s))
WHERE rank <= 5
"""


def _side(vector: str) -> str:
    planes = (
        f"CASE WHEN list_sum([round({vector}[i + 1]::DOUBLE * 1000000)::BIGINT * (1 - 2 * (bit_count(i & {2 * j + 1}) % 2)) "
        f"FOR i IN range(0, len({vector}))]) > 0 THEN {1 << j} ELSE 0 END"
        for j in range(8)
    )
    return f"({' + '.join(planes)})::INT"


_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"


def _assigned(pivots: str) -> str:
    """Every unit vector with the first of its nearest pivots."""
    return f"""(SELECT id, h, u, min_by(part, (-round(list_dot_product(u, axis), 9), part)) AS part FROM units, {pivots} GROUP BY id, h, u)"""


# Lists around pivots that moved once, and in the nearest lists a ranking by codes before the one by vectors.
Q["d4_indexed_top_k"] = f"""
WITH units AS (SELECT vec_id AS id, md5(vec_id::VARCHAR) AS h, {_UNIT.format("v")} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM {{embeddings}})),
wanted AS (SELECT ceil(sqrt(count(*)))::BIGINT AS p, count(*) AS n FROM units),
first AS (SELECT row_number() OVER (ORDER BY axis) - 1 AS part, axis
  FROM (SELECT DISTINCT list_transform(u, lambda x: round(x, 6)) AS axis FROM (SELECT u, row_number() OVER (ORDER BY h) AS r FROM units) WHERE r <= (SELECT p FROM wanted))),
sums AS (SELECT part, i, sum(x) AS x FROM (
  SELECT part, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM {_assigned("first")}, wanted
  WHERE ('0x' || substr(h, 1, 8))::BIGINT < least(1.0, 256 * p / n) * 4294967296) GROUP BY part, i),
totals AS (SELECT part, coalesce(moved, axis) AS total FROM first LEFT JOIN (SELECT part, list(x ORDER BY i) AS moved FROM sums GROUP BY part) USING (part)),
pivots AS (SELECT part, list_transform({_UNIT.format("total")}, lambda x: round(x, 6)) AS axis FROM totals),
coded AS (SELECT id, u, part, list_transform(range(1, len(u) + 1), lambda i: axis[i] + greatest(-127, least(127, floor((u[i] - axis[i]) * 127 + 0.5))) / 127) AS near
  FROM {_assigned("pivots")} JOIN pivots USING (part)),
asked AS (SELECT query_id, {_UNIT.format("embedding")} AS q FROM {_CENTROIDS}),
probed AS (SELECT query_id, q, part FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, axis), 9) DESC, part) AS place FROM asked, pivots) WHERE place <= 8),
kept AS (SELECT query_id, q, id, u FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, near), 9) DESC, id) AS place FROM probed JOIN coded USING (part)) WHERE place <= 40)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(list_dot_product(q, u), 9) AS score FROM kept))
WHERE rank <= 5
"""
for _name in ("d3_cosine_top_k", "d3_cosine_top_k_blocks", "d3_indexed_top_k"):
    Q[_name] = _COSINES % (_CENTROIDS, "")
Q["d4_approximate_top_k"] = _COSINES % (
    f"(SELECT *, {_side('embedding')} AS side FROM {_CENTROIDS})",
    f" WHERE bit_count(xor(q.side, {_side('s.embedding')})) <= 2",
)


def _rates(key: str) -> str:
    return f"""
SELECT {key}, events, elapsed AS elapsed_s, CASE WHEN elapsed > 0 THEN floor(events / elapsed + 0.5)::BIGINT ELSE 0 END AS per_second
FROM (SELECT {key}, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed FROM {{events}} GROUP BY 1)
"""


# A run comes with its third of the time or, every 50th, with the next. What came before
# sets the watermark: windows that end by then take no more rows, and only such are given.
Q["f1_watermarked_runs"] = """
SELECT * FROM (WITH runs AS (SELECT dag_id, ts, status, run_id, epoch_us(ts) AS us, date_trunc('day', ts) AS since FROM {run_log}),
span AS (SELECT min(us) AS low, greatest(1, (max(us) - min(us)) // 3 + 1) AS third FROM runs),
parts AS (SELECT runs.*, floor((us - low) / third) + CASE WHEN run_id % 50 = 0 THEN 1 ELSE 0 END AS part FROM runs, span),
marks AS (SELECT p.part, (SELECT max(ts) FROM parts b WHERE b.part < p.part) - INTERVAL 36 HOUR AS mark FROM (SELECT DISTINCT part FROM parts) p)
SELECT since, dag_id, count(*) AS run_count, count_if(status = 'failed') AS failure_count
FROM parts JOIN marks USING (part) WHERE (mark IS NULL OR since + INTERVAL 1 DAY > mark)
GROUP BY since, dag_id HAVING since + INTERVAL 1 DAY <= (SELECT max(ts) FROM runs) - INTERVAL 36 HOUR)
"""
Q["h5_dependent_pairs"] = """
SELECT a.source, a.target, r.source IS NOT NULL AS reaches FROM (
  SELECT target AS source, source AS target FROM {lineage} UNION SELECT source, 'rpt_30' FROM {lineage} UNION SELECT 'raw_hub', target FROM {lineage}) a
LEFT JOIN (SELECT DISTINCT source, target FROM (WITH RECURSIVE walk AS (
  SELECT source, target FROM {lineage} UNION SELECT w.source, e.target FROM walk w JOIN {lineage} e ON e.source = w.target) SELECT * FROM walk)) r
  ON r.source = a.source AND r.target = a.target
"""
Q["flow_load_tree"] = "SELECT name, len(columns)::INT AS n_columns, len(pii_names)::INT AS n_pii, true AS dated FROM {catalog}"
Q["flow_profile_file"] = "SELECT *, true AS filename, true AS analyzed_at FROM {quality}"
Q["flow_ask"] = Q["d8_prompts"]
Q["actions_get_lineage"] = "SELECT source, target, transformation, file FROM {lineage}"
Q["actions_get_health"] = "SELECT dag_id, status, slo_ok FROM {pipelines} WHERE NOT slo_ok"
Q["actions_get_tables"] = "SELECT name, len(columns)::INT AS n_columns FROM {catalog}"
Q["k1_stream_throughput"] = _rates("user_id")
Q["k1_batch_throughput"] = _rates("event_type")
Q["k2_batch_progress"] = Q["k2_stream_progress"] = Q["k2_closing_progress"] = """
SELECT run_id, stage, current, total, message, done, trunc(current / greatest(total, 1) * 100)::BIGINT AS pct, round_even(elapsed, 1) AS elapsed_s
FROM (SELECT run_id, unnest(max_by(struct_pack(stage := stage, current := current, total := total, message := message, done := done), (ts, seq))),
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed FROM {snapshots} GROUP BY run_id)
"""


def _full(sql: str) -> str:
    """The SQL with a WITH list of all views it needs, in order of dependence."""
    found: dict[str, str] = {}

    def add(text: str) -> str:
        for name in _needs(text):
            if name not in TABLES and name not in found:
                body = add(V[name])
                found[name] = body
        return text.format(**{n: n for n in _needs(text)})

    body = add(sql)
    if not found:
        return body
    # Steps used several times are computed once.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in found.items())
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {name: _full(sql) for name, sql in Q.items()}
