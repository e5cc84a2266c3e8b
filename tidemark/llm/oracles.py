"""SQL counterparts of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

ORACLES["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n - count(*) AS total, count(*) AS inter
  FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
), links AS (SELECT a, b FROM shared WHERE 100 * inter >= 75 * total),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
"""

ORACLES["op8_substring_dedup"] = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id),
removed AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ps, k)] END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

ORACLES["op4_exact_top_k"] = """
WITH coded AS (
  SELECT vec_id, bit_xor(CASE WHEN x > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << i END ELSE 0 END) AS code
  FROM (SELECT vec_id, unnest(embedding[:64]) AS x, unnest(range(0, least(len(embedding), 64))) AS i FROM embeddings) GROUP BY vec_id
), ranked AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(bit_count(xor(q.code, b.code)) AS INTEGER) AS distance,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, b.code)), b.vec_id) AS INTEGER) AS rank
  FROM coded q JOIN coded b ON q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

ORACLES["op6_quality_rules"] = f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), triples AS (
  SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM triples),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
counted AS (
  SELECT words.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated USING (r)
), measured AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), features AS (
  SELECT r, lang, source, base_failed, unnest(['repeated', 'symbols', 'dup_lines', 'word_length']) AS feature,
         least(1000, unnest([n_repeat_words * 1000 // greatest(n_words, 1), n_symbols * 1000 // greatest(word_chars, 1),
                             n_dup_lines * 1000 // greatest(n_lines, 1), word_chars * 10 // greatest(n_words, 1)])) AS value
  FROM measured
), clean AS (SELECT * FROM features WHERE NOT base_failed),
grouped AS (
  SELECT 1 AS level, lang, source, feature, value FROM clean
  UNION ALL SELECT 2, lang, NULL, feature, value FROM clean
  UNION ALL SELECT 3, NULL, NULL, feature, value FROM clean
), quantiles AS (
  SELECT level, lang, source, feature, count(*) AS texts, quantile_disc(value, 0.1) AS q10, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.9) AS q90
  FROM grouped GROUP BY ALL
), wide AS (
  SELECT w.lang, w.feature, (2 * (w.texts * w.q10 + 200 * e.q10) + w.texts + 200) // (2 * (w.texts + 200)) AS q10, (2 * (w.texts * w.q50 + 200 * e.q50) + w.texts + 200) // (2 * (w.texts + 200)) AS q50, (2 * (w.texts * w.q90 + 200 * e.q90) + w.texts + 200) // (2 * (w.texts + 200)) AS q90
  FROM quantiles w JOIN quantiles e ON e.level = 3 AND w.level = 2 AND e.feature = w.feature
), own AS (
  SELECT o.lang, o.source, o.feature, (2 * (o.texts * o.q10 + 200 * w.q10) + o.texts + 200) // (2 * (o.texts + 200)) AS q10, (2 * (o.texts * o.q50 + 200 * w.q50) + o.texts + 200) // (2 * (o.texts + 200)) AS q50, (2 * (o.texts * o.q90 + 200 * w.q90) + o.texts + 200) // (2 * (o.texts + 200)) AS q90
  FROM quantiles o JOIN wide w ON o.level = 1 AND o.feature = w.feature AND o.lang IS NOT DISTINCT FROM w.lang
), fences AS (
  SELECT lang, source, feature, CASE WHEN feature = 'word_length' THEN q10 - greatest(3 * (q50 - q10), 20) ELSE 0 END AS low,
         q90 + greatest(3 * (q90 - q50), CASE feature WHEN 'repeated' THEN 250 WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 350 ELSE 20 END) AS high
  FROM own
), chosen AS (
  SELECT f.r, f.value, x.low, x.high FROM features f JOIN fences x ON x.feature = f.feature
   AND f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source
), verdict AS (SELECT r, bool_and(value BETWEEN low AND high) AS within FROM chosen GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(within, true) AS kept
FROM measured LEFT JOIN verdict USING (r)
"""


def _crc32(hexed: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits; wants the table ``crc`` beside it."""
    each = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    step = "xor(c >> 8, crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: {step}), 4294967295)"


CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)
)"""

ORACLES["op13_importance_resampling"] = f"""
WITH {CRC_TABLE},
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), each AS (SELECT doc_id, unnest(w) AS f FROM words),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark
), hashed AS (
  SELECT f, {_crc32("h")} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM each UNION SELECT f FROM target)), crc
), s AS (SELECT bucket, count(*) AS n FROM each JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM each) + 10000)::DOUBLE
         / ((s.n + 1) * ((SELECT count(*) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT doc_id, sum(gain) AS weight FROM each JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

# Backward costs by recursion from the last turn on, then the walk of tight edits from the first.
_STAYS = "CASE t.cut WHEN 1 THEN 5 ELSE 0 END"
_OWN = {
    name: f"least(2 + b.{name}, CASE WHEN t.gone = 1 THEN 1000000000 ELSE {_STAYS} + least(1 + b.{to}, {kept}) END)"
    for name, to, kept in (
        ("e", "u", "CASE t.ini WHEN 's' THEN b.s WHEN 'u' THEN b.u ELSE 1000000000 END"), ("s", "u", "CASE t.ini WHEN 'u' THEN b.u ELSE 1000000000 END"),
        ("u", "a", "CASE t.ini WHEN 'a' THEN b.a ELSE 1000000000 END"), ("a", "u", "CASE t.ini WHEN 'u' THEN b.u ELSE 1000000000 END"),
    )
}
_COST = lambda side, state: f"(CASE {state} WHEN 'e' THEN {side}.e WHEN 's' THEN {side}.s WHEN 'u' THEN {side}.u ELSE {side}.a END)"
_TO = "(CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END)"
_KEPT = "(CASE WHEN w.state = 'e' AND t.ini IN ('s', 'u') THEN t.ini WHEN w.state IN ('s', 'a') AND t.ini = 'u' THEN 'u' WHEN w.state = 'u' AND t.ini = 'a' THEN 'a' END)"

ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE {CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("h")} % 20 AS kind
  FROM (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations), crc
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM rows_
), flags AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, last = '' AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, last NOT IN ('.', '!', '?') AS open,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), t AS (
  SELECT *, CASE WHEN blank OR again THEN 1 ELSE 0 END AS gone, CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM flags
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
         count_if(cut = 1) AS truncated, count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM t GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS i, 0 AS e, 10 AS s, 5 AS u, 0 AS a FROM faults
  UNION ALL
  SELECT conv_id, i, least(e, 5 + u, 10 + a) AS e, least(s, 5 + u, 10 + a) AS s, least(u, 5 + a) AS u, least(a, 5 + u) AS a
  FROM (SELECT b.conv_id, t.i, {", ".join(f"{sql} AS {name}" for name, sql in _OWN.items())}
        FROM back b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1)
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 'e' AS state, '' AS audit, NULL::VARCHAR AS lines FROM faults
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN state WHEN 'K' THEN kept ELSE step END, audit || edit,
         CASE edit WHEN 'D' THEN lines ELSE coalesce(lines || chr(10), '') || CASE WHEN edit = 'K' THEN role WHEN step = 'u' THEN 'user' ELSE 'assistant' END
              || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END
  FROM (
    SELECT w.*, t.role, t.text, {_TO} AS step, {_KEPT} AS kept,
           CASE WHEN t.i IS NULL THEN 'I'
                WHEN 2 + {_COST("g", "w.state")} = {_COST("h", "w.state")} THEN 'D' WHEN 5 + {_COST("h", _TO)} = {_COST("h", "w.state")} THEN 'I'
                WHEN {_KEPT} IS NOT NULL AND {_STAYS} + {_COST("g", _KEPT)} = {_COST("h", "w.state")} THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN back h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
    LEFT JOIN back g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1
    LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
    WHERE t.i IS NOT NULL OR w.state IN ('s', 'u')
  )
), ended AS (SELECT w.conv_id, audit, lines FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n + 1 WHERE w.state IN ('e', 'a'))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.e, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 LEFT JOIN ended w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
