"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL rebuilds the same raw log text from ``events`` but takes the expected
parsed fields straight from the ``events`` columns, never by re-parsing the
text, so a parser bug cannot hide behind an identical bug in the oracle.
"""

from __future__ import annotations

from ..config import ABSTENTION_SENTENCE, Params
from .driver_tables import CHUNK_OVERLAP, CHUNK_SIZE, EVAL_QUERIES, HASH_DIM, PHENOMENA, RETRIEVE_QUERY


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# -- rendered logs -------------------------------------------------------------

BASE = f"""
ev_base AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE WHEN event_type = 'click' THEN 301
         WHEN event_type = 'view' AND event_id % 3 = 0 THEN 204
         WHEN event_type IN ('view', 'purchase') THEN 200
         WHEN event_type = 'signup' THEN 404
         WHEN event_type = 'error' THEN 503 ELSE 200 END AS h_status,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST'
         WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'OPTIONS' ELSE 'GET' END AS h_method,
    CASE WHEN event_id % 13 = 0 THEN '/health'
         WHEN event_type IN ('purchase', 'signup') THEN '/api/' || event_type
         ELSE '/' || event_type || '/' || {s('event_id % 50')} END AS h_path,
    event_id % 97 = 0 AS h_corrupt,
    (event_id % 101 = 0 AND event_id % 97 <> 0) AS h_blank
  FROM events
)"""

HX = f"""
hx AS (
  SELECT b.*, 'app_' || {s('event_id % 5')} || '.log' AS source_file,
    event_id // 5 + 1 AS line_number
  FROM ev_base b
),
hx_lines AS (
  SELECT source_file, line_number, event_id, h_corrupt, h_blank,
    CASE WHEN h_corrupt THEN 'corrupt entry ' || {s('event_id')} || ' ' || event_type
         WHEN h_blank THEN ''
         ELSE strftime(ts, '%b %d %H:%M:%S') || ' lb' || {s('user_id % 3')} || ' haproxy[' || {s('user_id % 5 + 1000')}
           || ']: 10.' || {s('user_id % 256')} || '.' || {s('(event_id // 256) % 256')} || '.' || {s('event_id % 256')}
           || ':' || {s('event_id % 20000 + 40000')} || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S.%g') || '] '
           || CASE WHEN event_id % 2 = 0 THEN 'fe_main' ELSE 'fe_main~' END || ' '
           || CASE WHEN event_type = 'error' THEN 'be_api/<NOSRV>' ELSE 'be_app/srv' || {s('user_id % 3')} END || ' '
           || CASE WHEN event_type = 'error' THEN '0/-1/-1/-1/-1'
                   ELSE '0/0/0/' || {s('CAST(floor(value) AS BIGINT)')} || '/' || {s('CAST(floor(value) AS BIGINT)')} END
           || ' ' || {s('h_status')} || ' ' || {s('CAST(floor(value * 10) AS BIGINT)')} || ' - - '
           || CASE WHEN event_type = 'error' THEN 'SC--' ELSE '----' END || ' 1/1/0/0/0 0/0 '
           || CASE WHEN event_id % 11 = 0 THEN '{{h' || {s('user_id')} || '.example}} {{-}} '
                   WHEN event_id % 7 = 0 THEN '{{h' || {s('user_id')} || '.example}} ' ELSE '' END
           || '"' || CASE WHEN event_id % 89 = 0 THEN '' ELSE h_method || ' ' || h_path || ' HTTP/1.1' END || '"'
    END AS raw,
    ts, user_id, event_type, value, h_status, h_method, h_path
  FROM hx
),
hx_events AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
    'haproxy' AS source,
    CASE WHEN h_status BETWEEN 500 AND 599 THEN 'error' WHEN h_status BETWEEN 400 AND 499 THEN 'warning'
         ELSE 'info' END AS severity,
    '10.' || {s('user_id % 256')} || '.' || {s('(event_id // 256) % 256')} || '.' || {s('event_id % 256')} AS client_ip,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE h_method END AS method,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE h_path END AS path,
    CAST(h_status AS INTEGER) AS status_code,
    CAST(floor(value * 10) AS BIGINT) AS bytes,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'be_api/<NOSRV>' ELSE 'be_app/srv' || {s('user_id % 3')} END AS backend,
    source_file, CAST(line_number AS BIGINT) AS line_number, raw, event_id
  FROM hx_lines WHERE NOT h_corrupt AND NOT h_blank
)"""

_IIS_A = ("date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip "
          "cs(User-Agent) sc-status sc-substatus sc-win32-status time-taken")
_IIS_B = "date time c-ip cs-method cs-uri-stem sc-status sc-bytes time-taken"

IX = f"""
ix0 AS (
  SELECT b.*, CASE event_id % 3 WHEN 0 THEN 'u_ex240101.log' WHEN 1 THEN 'iis_site1.log' ELSE 'w3svc_2.log' END
      AS source_file,
    event_id // 3 + 1 AS k
  FROM ev_base b
),
ix AS (
  SELECT *, (k - 1) // 50 AS block, k + (k - 1) // 50 + 2 AS line_number,
    strftime(ts, '%Y-%m-%d') AS d_s, strftime(ts, '%H:%M:%S') AS t_s,
    CASE WHEN event_id % 89 = 0 THEN '-' ELSE h_method END AS m_s,
    CASE WHEN event_id % 9 = 0 THEN '-' ELSE '10.2.' || {s('user_id % 256')} || '.' || {s('event_id % 256')} END AS c_s,
    CASE WHEN event_id % 4 = 0 THEN 'id=' || {s('user_id')} ELSE '-' END AS q_s
  FROM ix0
),
ix_data AS (
  SELECT source_file, CAST(line_number AS BIGINT) AS line_number, block, event_id, h_corrupt, h_blank,
    CASE WHEN h_blank THEN ''
         WHEN block % 2 = 0 THEN d_s || ' ' || t_s || ' 10.1.0.' || {s('user_id % 3 + 1')} || ' ' || m_s || ' ' || h_path
              || ' ' || q_s || ' 443 - ' || c_s || ' Mozilla/5.0+(Windows+NT+10.0) ' || {s('h_status')} || ' 0 0'
              || CASE WHEN h_corrupt THEN '' ELSE ' ' || {s('CAST(floor(value) AS BIGINT)')} END
         ELSE d_s || ' ' || t_s || ' ' || c_s || ' ' || m_s || ' ' || h_path || ' ' || {s('h_status')} || ' '
              || {s('CAST(floor(value * 10) AS BIGINT)')}
              || CASE WHEN h_corrupt THEN '' ELSE ' ' || {s('CAST(floor(value) AS BIGINT)')} END
    END AS raw,
    ts, user_id, event_type, value, h_status, m_s, c_s, q_s, h_path
  FROM ix
),
ix_lines AS (
  SELECT source_file, line_number, raw FROM ix_data
  UNION ALL
  SELECT source_file, CAST(block * 51 + 2 AS BIGINT),
    '#Fields: ' || CASE WHEN block % 2 = 0 THEN '{_IIS_A}' ELSE '{_IIS_B}' END
  FROM ix WHERE (k - 1) % 50 = 0
  UNION ALL
  SELECT source_file, CAST(1 AS BIGINT), '#Software: Microsoft Internet Information Services 10.0' FROM ix WHERE k = 1
),
ix_events AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
    'iis' AS source,
    CASE WHEN h_status BETWEEN 500 AND 599 THEN 'error' WHEN h_status BETWEEN 400 AND 499 THEN 'warning'
         ELSE 'info' END AS severity,
    NULLIF(c_s, '-') AS client_ip,
    NULLIF(m_s, '-') AS method,
    h_path || CASE WHEN block % 2 = 0 AND q_s <> '-' THEN '?' || q_s ELSE '' END AS path,
    CAST(h_status AS INTEGER) AS status_code,
    CASE WHEN block % 2 = 1 THEN CAST(floor(value * 10) AS BIGINT) END AS bytes,
    CAST(floor(value) AS BIGINT) AS duration_ms,
    CAST(NULL AS VARCHAR) AS backend,
    source_file, line_number, raw, event_id
  FROM ix_data WHERE NOT h_corrupt AND NOT h_blank
)"""

EVENT_COLS = ("timestamp, source, severity, client_ip, method, path, status_code, bytes, duration_ms, backend, "
              "source_file, line_number, raw")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


LOGS = with_(BASE, HX, IX)

# -- chunks ---------------------------------------------------------------------

STEP = CHUNK_SIZE - CHUNK_OVERLAP

CHUNKS = f"""
ce AS (
  SELECT e.*, row_number() OVER (PARTITION BY source_file ORDER BY line_number) - 1 AS p,
    count(*) OVER (PARTITION BY source_file) AS n,
    '[' || coalesce(timestamp, '-') || '] ' || source || ' ' || severity || ' ' || coalesce(method, '-') || ' '
      || coalesce(path, '-') || ' ' || coalesce({s('status_code')}, '-') || ' '
      || CASE WHEN duration_ms IS NULL THEN '-' ELSE {s('duration_ms')} || 'ms' END || ' '
      || coalesce(backend, '-') AS line_txt
  FROM hx_events e
),
cx AS (
  SELECT ce.*, c AS chunk_index
  FROM ce, LATERAL (SELECT unnest(generate_series(
      CAST(greatest(0, floor((p - {CHUNK_SIZE}) / {STEP}) + 1) AS BIGINT),
      CAST(least(floor(p / {STEP}), CASE WHEN n <= {CHUNK_SIZE} THEN 0 ELSE ceil((n - {CHUNK_SIZE}) / {STEP}) END)
           AS BIGINT))) AS c)
),
chunks AS (
  SELECT regexp_replace(source_file, '\\.[^.]*$', '') || '-' || {s('chunk_index')} AS chunk_id,
    source_file, chunk_index,
    arg_min(line_number, p) AS line_start, arg_max(line_number, p) AS line_end,
    min(NULLIF(timestamp, '')) AS ts_start, max(NULLIF(timestamp, '')) AS ts_end,
    CAST(count(*) AS INTEGER) AS n_events,
    CAST(count(*) FILTER (WHERE severity = 'info') AS INTEGER) AS sev_info,
    CAST(count(*) FILTER (WHERE severity = 'warning') AS INTEGER) AS sev_warning,
    CAST(count(*) FILTER (WHERE severity = 'error') AS INTEGER) AS sev_error,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    string_agg({s('line_number')}, ',' ORDER BY p) AS event_lines,
    string_agg(line_txt, chr(10) ORDER BY p) AS text,
    list_sort(list(DISTINCT backend)) AS backends,
    min(p) AS p_first
  FROM cx GROUP BY source_file, chunk_index
)"""

# -- hashing encoder ------------------------------------------------------------

TOKENS = f"""
tok AS (
  SELECT chunk_id, t, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {HASH_DIM} AS b
  FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9/<>]+')) AS t FROM chunks)
  WHERE t <> ''
),
bc AS (SELECT chunk_id, b, count(*) AS c FROM tok GROUP BY chunk_id, b),
nrm AS (SELECT chunk_id, sqrt(sum(c * c)) AS nn FROM bc GROUP BY chunk_id),
cvec AS (
  SELECT bc.chunk_id, bc.b, CAST(CAST(bc.c / nrm.nn AS FLOAT) AS DOUBLE) AS w
  FROM bc JOIN nrm USING (chunk_id)
)"""


def query_vec_cte(name: str, text: str) -> str:
    lit = text.replace("'", "''")
    return f"""
{name}_tok AS (
  SELECT CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {HASH_DIM} AS b
  FROM (SELECT unnest(regexp_split_to_array(lower('{lit}'), '[^a-z0-9/<>]+')) AS t) WHERE t <> ''
),
{name}_bc AS (SELECT b, count(*) AS c FROM {name}_tok GROUP BY b),
{name} AS (SELECT b, CAST(CAST(c / (SELECT sqrt(sum(c * c)) FROM {name}_bc) AS FLOAT) AS DOUBLE) AS w FROM {name}_bc)"""


POINTS = """
pts AS (
  SELECT chunk_id AS id, source_file || ':' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) AS document,
    source_file, line_start, line_end, coalesce(ts_start, '') AS ts_start, coalesce(ts_end, '') AS ts_end,
    sev_info, sev_warning, sev_error, text, backends, chunk_index
  FROM chunks
),
pnorm AS (SELECT chunk_id AS id, sqrt(sum(w * w)) AS pn FROM cvec GROUP BY chunk_id)"""


def text_topk_sql(query: str, top_k: int, where: str = "TRUE", extra: str = "") -> str:
    """Cosine top-k of one text query against the chunk points (sparse dot product)."""
    return (
        with_(BASE, HX, CHUNKS, TOKENS, POINTS, query_vec_cte("qv", query))
        + f""",
qn AS (SELECT sqrt(sum(w * w)) AS qn FROM qv),
dots AS (SELECT cvec.chunk_id AS id, sum(cvec.w * qv.w) AS dot FROM cvec JOIN qv USING (b) GROUP BY cvec.chunk_id),
scored AS (
  SELECT pts.*, CASE WHEN pnorm.pn > 0 AND (SELECT qn FROM qn) > 0
                     THEN 1 - coalesce(dots.dot, 0) / (pnorm.pn * (SELECT qn FROM qn)) ELSE 1.0 END AS distance
  FROM pts LEFT JOIN dots USING (id) LEFT JOIN pnorm USING (id)
  WHERE {where}
),
top AS (SELECT * FROM scored ORDER BY round(distance, 10), id LIMIT {top_k})
SELECT id AS chunk_id, round(1 - distance, 4) AS score, round(distance, 4) AS distance, document, source_file,
  line_start, line_end, NULLIF(ts_start, '') AS ts_start, NULLIF(ts_end, '') AS ts_end,
  sev_info, sev_warning, sev_error,
  CAST(row_number() OVER (ORDER BY round(1 - distance, 4) DESC, round(distance, 10), id) AS INTEGER) AS rank{extra}
FROM top"""
    )


# -- vector table ---------------------------------------------------------------

VPTS = """
vp AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e,
    'label_' || CAST(label AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR) || '-' || CAST(vec_id AS VARCHAR) AS document,
    'label_' || CAST(label AS VARCHAR) AS source_file, CAST(vec_id AS BIGINT) AS line_start,
    CAST(vec_id AS BIGINT) AS line_end, '' AS ts_start, '' AS ts_end,
    1 AS sev_info, 0 AS sev_warning, CAST(label % 3 AS INTEGER) AS sev_error
  FROM embeddings
),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings ORDER BY vec_id LIMIT 1)"""


def vector_topk_sql(metric: str, top_k: int = 10, where: str = "TRUE", threshold: float = 0.0) -> str:
    if metric == "cosine":
        dist = ("CASE WHEN list_dot_product(e, e) > 0 AND list_dot_product(qe, qe) > 0 THEN "
                "1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) "
                "ELSE 1.0 END")
        score = "1 - distance"
    elif metric == "l2":
        dist = "list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        score = "1 / (1 + distance)"
    else:
        dist = "1 - list_dot_product(e, qe)"
        score = "1 / (1 + distance)"
    return with_(VPTS) + f""",
scored AS (SELECT vp.*, {dist} AS distance FROM vp, q WHERE {where}),
top AS (SELECT *, {score} AS score_raw FROM scored ORDER BY round(distance, 10), id LIMIT {top_k}),
kept AS (SELECT * FROM top WHERE score_raw >= {threshold})
SELECT id AS chunk_id, round(score_raw, 4) AS score, round(distance, 4) AS distance, document, source_file,
  line_start, line_end, NULLIF(ts_start, '') AS ts_start, NULLIF(ts_end, '') AS ts_end,
  sev_info, sev_warning, sev_error,
  CAST(row_number() OVER (ORDER BY round(score_raw, 4) DESC, round(distance, 10), id) AS INTEGER) AS rank
FROM kept"""


# -- registered oracles ----------------------------------------------------------

def _eval_values() -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, t, _ in EVAL_QUERIES)
    return rows


SQL: dict[str, str] = {}

SQL["q_parse_haproxy"] = with_(BASE, HX) + f"SELECT {EVENT_COLS} FROM hx_events"
SQL["q_parse_iis"] = with_(BASE, IX) + f"SELECT {EVENT_COLS} FROM ix_events"
SQL["q_iis_header_asof"] = with_(BASE, IX) + """
SELECT source_file, line_number, CAST(block * 51 + 2 AS BIGINT) AS header_line,
  CAST(CASE WHEN block % 2 = 0 THEN 14 ELSE 8 END AS INTEGER) AS n_fields
FROM ix_data WHERE NOT h_blank"""
SQL["q_detect_source"] = LOGS + """,
all_lines AS (SELECT source_file, line_number, raw FROM hx_lines UNION ALL SELECT * FROM ix_lines),
head AS (
  SELECT source_file, bool_or(lower(raw) LIKE '#fields:%' OR lower(raw) LIKE '#software%') AS w3c
  FROM all_lines WHERE line_number <= 10 GROUP BY source_file
)
SELECT source_file,
  CASE WHEN lower(source_file) LIKE '%haproxy%' THEN 'haproxy'
       WHEN lower(source_file) LIKE '%iis%' OR lower(source_file) LIKE 'u_ex%' THEN 'iis'
       WHEN w3c THEN 'iis' ELSE 'haproxy' END AS source
FROM head"""
SQL["q_severity_hist"] = LOGS + """,
ev AS (SELECT source, severity FROM hx_events UNION ALL SELECT source, severity FROM ix_events)
SELECT source, severity, count(*) AS n_events FROM ev GROUP BY source, severity"""
SQL["q_parse_stats"] = LOGS + """,
per AS (
  SELECT source_file, 'haproxy' AS source, CAST(1 AS BIGINT) AS files, count(*) AS lines,
    count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank) AS ok,
    count(*) FILTER (WHERE h_corrupt) AS skipped_errors, CAST(0 AS BIGINT) AS kept_errors
  FROM hx_lines GROUP BY source_file
  UNION ALL
  SELECT d.source_file, 'iis', 1, count(*) + max(d.block) + 2,
    count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank), count(*) FILTER (WHERE h_corrupt), 0
  FROM ix_data d GROUP BY d.source_file
)
SELECT source_file, source, files, lines, ok, skipped_errors, kept_errors, ok + kept_errors AS events, FALSE AS is_total
FROM per
UNION ALL
SELECT NULL, NULL, CAST(sum(files) AS BIGINT), CAST(sum(lines) AS BIGINT), CAST(sum(ok) AS BIGINT),
  CAST(sum(skipped_errors) AS BIGINT), CAST(sum(kept_errors) AS BIGINT),
  CAST(sum(ok) + sum(kept_errors) AS BIGINT), TRUE FROM per"""
SQL["q_on_error_keep"] = with_(BASE, HX) + f"""
SELECT {EVENT_COLS} FROM hx_events
UNION ALL
SELECT NULL, 'haproxy', 'info', NULL, NULL, NULL, NULL, NULL, NULL, NULL, source_file,
  CAST(line_number AS BIGINT), raw
FROM hx_lines WHERE h_corrupt"""
SQL["q_chunk_events"] = with_(BASE, HX, CHUNKS) + """,
sevfirst AS (
  SELECT source_file, chunk_index, severity, min(p) AS first_p, count(*) AS c FROM cx
  GROUP BY source_file, chunk_index, severity
),
sevtxt AS (
  SELECT source_file, chunk_index, string_agg(severity || ':' || CAST(c AS VARCHAR), ', ' ORDER BY first_p) AS t
  FROM sevfirst GROUP BY source_file, chunk_index
)
SELECT chunk_id, source_file, line_start, line_end, ts_start, ts_end, n_events, sev_info, sev_warning, sev_error,
  sources, event_lines, sevtxt.t AS severities_text
FROM chunks JOIN sevtxt USING (source_file, chunk_index)"""
SQL["q_chunk_text"] = with_(BASE, HX, CHUNKS) + "SELECT chunk_id, text FROM chunks"
SQL["q_embed"] = with_(BASE, HX, CHUNKS, TOKENS) + f"""
SELECT chunks.chunk_id, 'hash-md5-{HASH_DIM}' AS embedding_model, CAST({HASH_DIM} AS INTEGER) AS embedding_dim,
  CAST(coalesce(t.n_tokens, 0) AS INTEGER) AS n_tokens, coalesce(v.bucket_sig, 0) AS bucket_sig,
  CAST(coalesce(v.n_buckets, 0) AS INTEGER) AS n_buckets, round(coalesce(v.max_w, 0), 6) AS max_weight
FROM chunks
LEFT JOIN (SELECT chunk_id, count(*) AS n_tokens FROM tok GROUP BY chunk_id) t USING (chunk_id)
LEFT JOIN (SELECT chunk_id, count(*) AS n_buckets, CAST(sum(b + 1) AS BIGINT) AS bucket_sig, max(w) AS max_w FROM cvec
           GROUP BY chunk_id) v USING (chunk_id)"""
SQL["q_topk_cosine"] = vector_topk_sql("cosine")
SQL["q_topk_l2"] = vector_topk_sql("l2")
SQL["q_topk_ip"] = vector_topk_sql("ip")
SQL["q_topk_filtered"] = vector_topk_sql("cosine", where="source_file = 'label_1' AND sev_error > 0")
SQL["q_topk_threshold"] = vector_topk_sql("cosine", top_k=20, threshold=0.25)
SQL["q_retrieve_text"] = text_topk_sql(RETRIEVE_QUERY, 5)
SQL["q_topk_time_filter"] = text_topk_sql(
    RETRIEVE_QUERY, 5,
    where="ts_end <> '' AND ts_end >= '2024-01-05T00:00:00+00:00' AND ts_start <> '' "
          "AND ts_start <= '2024-01-20T23:59:59+00:00' AND list_contains(backends, 'be_api/<NOSRV>')",
)
SQL["q_citation"] = with_(BASE, HX, CHUNKS, POINTS) + f"""
SELECT id, document, source_file, line_start, line_end, ts_start, ts_end, CAST({HASH_DIM} AS INTEGER) AS embedding_dim,
  sev_info, sev_warning, sev_error FROM pts"""
SQL["q_split_lines"] = """
WITH parts AS (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a
  FROM documents WHERE text IS NOT NULL
),
trimmed AS (
  SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM parts
)
SELECT doc_id, CAST(i AS BIGINT) AS line_number, CAST(length(a[i]) AS INTEGER) AS n_chars, md5(a[i]) AS line_md5
FROM trimmed, LATERAL (SELECT unnest(generate_series(1, len(a))) AS i)
WHERE len(a) > 0"""


def batch_sql(top_k: int = 3) -> str:
    """All evaluation queries against the chunk points, top-k each."""
    vals = _eval_values()
    return with_(BASE, HX, CHUNKS, TOKENS, POINTS) + f""",
qs AS (SELECT * FROM (VALUES {vals}) AS v(query_id, query)),
qtok AS (
  SELECT query_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {HASH_DIM} AS b
  FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^a-z0-9/<>]+')) AS t FROM qs) WHERE t <> ''
),
qbc AS (SELECT query_id, b, count(*) AS c FROM qtok GROUP BY query_id, b),
qv AS (
  SELECT query_id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS w FROM qbc
),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qv GROUP BY query_id),
dots AS (
  SELECT qv.query_id, cvec.chunk_id AS id, sum(cvec.w * qv.w) AS dot
  FROM cvec JOIN qv USING (b) GROUP BY qv.query_id, cvec.chunk_id
),
scored AS (
  SELECT qn.query_id, pts.*, CASE WHEN pnorm.pn > 0 AND qn.qn > 0
      THEN 1 - coalesce(dots.dot, 0) / (pnorm.pn * qn.qn) ELSE 1.0 END AS distance
  FROM qn CROSS JOIN pts LEFT JOIN pnorm USING (id)
  LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = pts.id
),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), id) AS r FROM scored
  ) WHERE r <= {top_k}
)
SELECT query_id, id AS chunk_id, round(1 - distance, 4) AS score, round(distance, 4) AS distance, document,
  source_file, line_start, line_end, NULLIF(ts_start, '') AS ts_start, NULLIF(ts_end, '') AS ts_end,
  sev_info, sev_warning, sev_error,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 - distance, 4) DESC, round(distance, 10), id)
       AS INTEGER) AS rank,
  text, chunk_index
FROM top"""


SQL["q_batch_retrieve"] = (
    "SELECT query_id, chunk_id, score, distance, document, source_file, line_start, line_end, ts_start, ts_end, "
    "sev_info, sev_warning, sev_error, rank FROM (" + batch_sql(3) + ")"
)




def sev_text(kv: str, sep: str, empty: str) -> str:
    parts = ", ".join(
        f"CASE WHEN sev_{k} > 0 THEN '{k}{kv}' || CAST(sev_{k} AS VARCHAR) END" for k in ("info", "warning", "error"))
    return f"coalesce(NULLIF(array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '{sep}'), ''), '{empty}')"


VP_NEW = VPTS + """,
cur AS (SELECT id, 'v1' AS embedding_model, document, source_file, sev_error FROM vp),
new AS (SELECT CAST(CAST(id AS BIGINT) + 250 AS VARCHAR) AS id, 'v2' AS embedding_model, document, source_file,
               sev_error FROM vp),
up AS (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new)"""

SQL["q_index_upsert"] = with_(VP_NEW) + "SELECT * FROM up"
SQL["q_index_count"] = with_(VP_NEW) + "SELECT embedding_model, count(*) AS n_points FROM up GROUP BY embedding_model"

SQL["q_render_results"] = f"""
WITH res AS ({text_topk_sql(RETRIEVE_QUERY, 5)})
SELECT rank, '#' || CAST(rank AS VARCHAR) || '  score=' || printf('%.4f', score) || '  ' || document || chr(10)
  || '     chunk=' || chunk_id || '  líneas ' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR)
  || '  ts=' || coalesce(ts_start, 'None') || '..' || coalesce(ts_end, 'None')
  || '  severidades=[' || {sev_text(':', ', ', '-')} || ']' AS rendered
FROM res"""

SQL["q_corpus_report"] = LOGS + f""",
per AS (
  SELECT source_file, count(*) AS lines, count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank) AS events
  FROM hx_lines GROUP BY source_file
  UNION ALL
  SELECT source_file, count(*) + max(block) + 2, count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank)
  FROM ix_data GROUP BY source_file
),
per2 AS (
  SELECT source_file, CAST(1 AS BIGINT) AS files, lines, events,
    CAST(CASE WHEN events = 0 THEN 0 WHEN events <= {CHUNK_SIZE} THEN 1
              ELSE 1 + ceil((events - {CHUNK_SIZE}) / {STEP}) END AS BIGINT) AS chunks
  FROM per
)
SELECT source_file, files, lines, events, chunks, chunks AS embeddings, FALSE AS is_total FROM per2
UNION ALL
SELECT NULL, count(*), CAST(sum(lines) AS BIGINT), CAST(sum(events) AS BIGINT), CAST(sum(chunks) AS BIGINT),
  CAST(sum(chunks) AS BIGINT), TRUE FROM per2"""

SQL["q_jsonl_roundtrip"] = SQL["q_parse_haproxy"]

SQL["q_line_boundaries"] = """
WITH marked AS (
  SELECT replace(text, '. ', CASE doc_id % 4 WHEN 0 THEN chr(11) WHEN 1 THEN chr(8232) WHEN 2 THEN chr(13)
                             ELSE chr(133) || chr(28) END) || chr(10) AS text
  FROM documents WHERE text IS NOT NULL
),
parts AS (
  SELECT regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a FROM marked
),
lines AS (SELECT unnest(a[1:len(a) - 1]) AS raw FROM parts)
SELECT CAST(length(raw) AS INTEGER) AS n_chars, count(*) AS n_lines, min(md5(raw)) AS first_md5, max(md5(raw)) AS last_md5
FROM lines GROUP BY 1"""

SQL["q_read_files"] = with_(BASE, HX) + """
SELECT regexp_replace(source_file, '[.]log$', '') AS app, count(*) AS lines,
  count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank) AS ok,
  count(*) FILTER (WHERE h_corrupt) AS errors,
  count(*) FILTER (WHERE h_blank) AS skipped,
  CAST(sum(length(raw)) AS BIGINT) AS chars,
  TRUE AS numbered_1_to_n
FROM hx_lines GROUP BY 1"""

SQL["q_discover"] = with_(BASE, HX) + """
SELECT regexp_replace(source_file, '[.]log$', '') AS app, CAST(sum(strlen(raw) + 1) AS BIGINT) AS total_bytes
FROM hx_lines GROUP BY 1"""

CX_ID = "regexp_replace(source_file, '\\.[^.]*$', '') || '-' || CAST(chunk_index AS VARCHAR)"

SQL["q_chunk_status_hist"] = with_(BASE, HX, CHUNKS) + f"""
SELECT {CX_ID} AS chunk_id, 'status' AS dimension, CAST(status_code AS VARCHAR) AS value, count(*) AS n
FROM cx GROUP BY 1, 3
UNION ALL
SELECT {CX_ID}, 'method', method, count(*) FROM cx GROUP BY 1, 3"""


def _pred_case() -> str:
    whens = " ".join(f"WHEN '{q}' THEN coalesce(({p}), FALSE)" for q, _, p in EVAL_QUERIES)
    return f"CASE query_id {whens} ELSE FALSE END"


LABELS = f"""
br AS ({batch_sql(3)}),
lab0 AS (
  SELECT br.query_id, br.rank, br.chunk_id, count(*) AS n_events,
    count(*) FILTER (WHERE {_pred_case().replace('query_id', 'br.query_id', 1)}) AS n_match
  FROM br JOIN cx ON cx.source_file = br.source_file AND cx.chunk_index = br.chunk_index
  GROUP BY br.query_id, br.rank, br.chunk_id
),
labels AS (
  SELECT query_id, rank, chunk_id, n_events, n_match, round(n_match / n_events, 4) AS share,
    CASE WHEN n_match / n_events >= 0.5 THEN 'R' WHEN n_match > 0 THEN 'P' ELSE 'N' END AS label
  FROM lab0
),
labels2 AS (
  SELECT *, CASE label WHEN 'R' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END AS weight FROM labels
)"""


def _with_labels() -> str:
    # batch_sql() starts with its own WITH; splice its CTEs in front of ours.
    b = batch_sql(3)
    head, body = b.split("\nSELECT query_id, id AS chunk_id", 1)
    return head + ",\nbr AS (SELECT query_id, id AS chunk_id" + body + ")," + LABELS.split("br AS (" + b + "),", 1)[1]


SQL["q_relevance_labels"] = _with_labels() + """
SELECT query_id, rank, chunk_id, n_events, n_match, share, label, CAST(weight AS DOUBLE) AS weight FROM labels2"""

SQL["q_precision_at_k"] = _with_labels() + """,
per_q AS (
  SELECT query_id, max(CASE WHEN rank = 1 THEN label END) AS l1, max(CASE WHEN rank = 1 THEN weight END) AS w1,
    sum(CASE WHEN rank <= 3 THEN weight END) AS wk,
    max(CASE WHEN rank <= 3 AND label IN ('R', 'P') THEN 1 ELSE 0 END) AS hit
  FROM labels2 GROUP BY query_id
)
SELECT count(*) AS n_queries,
  round(avg(CASE WHEN l1 = 'R' THEN 1.0 ELSE 0.0 END), 4) AS p1_strict,
  round(avg(CASE WHEN l1 IN ('R', 'P') THEN 1.0 ELSE 0.0 END), 4) AS p1_r_or_p,
  round(avg(coalesce(w1, 0.0)), 4) AS p1_weighted,
  round(avg(coalesce(wk, 0.0) / 3), 4) AS p3_weighted,
  round(avg(CAST(hit AS DOUBLE)), 4) AS success3
FROM per_q"""

_PH = " UNION ALL ".join(
    [f"SELECT 'all_events' AS phenomenon, count(*) AS n_events FROM ev"]
    + [f"SELECT '{n}', count(*) FILTER (WHERE coalesce(({p}), FALSE)) FROM ev" for n, p in PHENOMENA]
)
SQL["q_phenomena"] = LOGS + f""",
ev AS (SELECT * EXCLUDE (event_id) FROM hx_events UNION ALL SELECT * EXCLUDE (event_id) FROM ix_events)
{_PH}"""

EVID_HEADER = ("'[E' || CAST(rank AS VARCHAR) || '] (score ' || printf('%.2f', score) || ') origen=' || source_file"
               " || ' líneas=' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR)"
               " || chr(10) || '     ts=' || coalesce(ts_start, '-') || '..' || coalesce(ts_end, '-')"
               f" || ' severidades=' || {sev_text(':', ',', '-')}")

SQL["q_evidence"] = f"""
WITH res AS ({text_topk_sql(RETRIEVE_QUERY, 5, extra=', text')})
SELECT 'E' || CAST(rank AS VARCHAR) AS evidence_id, chunk_id, {EVID_HEADER} AS header, coalesce(text, '') AS text
FROM res"""

ANSWERS = f"""
ans AS (
  SELECT conv_id, turn,
    CASE WHEN conv_id % 10 = 0 THEN '{ABSTENTION_SENTENCE}'
         ELSE coalesce(text, '') || ' [E' || CAST((conv_id + turn) % 7 + 1 AS VARCHAR) || ']' END AS answer
  FROM conversations WHERE role = 'assistant'
)"""

SQL["q_expand_citations"] = f"""
WITH res AS ({text_topk_sql(RETRIEVE_QUERY, 5)}),
{ANSWERS},
ev AS (
  SELECT CAST(rank AS BIGINT) AS marker_no, '[E' || CAST(rank AS VARCHAR) || '] ' || source_file || ':L'
    || CAST(line_start AS VARCHAR) || '-L' || CAST(line_end AS VARCHAR) || ' · ' || coalesce(ts_start, '-')
    || ' → ' || coalesce(ts_end, '-') || ' · ' || {sev_text('×', ', ', '-')} AS expanded
  FROM res
),
m AS (
  SELECT conv_id, turn, regexp_extract_all(answer, '\\[E([0-9]+)\\]', 1) AS nums FROM ans
),
mx AS (
  SELECT conv_id, turn, i AS marker_pos, nums[i] AS num
  FROM m, LATERAL (SELECT unnest(generate_series(1, len(nums))) AS i) WHERE len(nums) > 0
)
SELECT conv_id, turn, CAST(marker_pos AS INTEGER) AS marker_pos, '[E' || num || ']' AS marker, ev.expanded,
  ev.expanded IS NOT NULL AS is_known
FROM mx LEFT JOIN ev ON ev.marker_no = CAST(num AS BIGINT)"""

SQL["q_validate_citations"] = f"""
WITH {ANSWERS},
x AS (
  SELECT conv_id, turn, answer,
    list_transform(regexp_extract_all(answer, '\\[E([0-9]+)\\]', 1), lambda v: CAST(v AS INTEGER)) AS nums,
    list_filter(list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda p: trim(p) <> ''),
                lambda p: regexp_matches(p, '\\p{{L}}')) AS factual
  FROM ans
),
y AS (
  SELECT conv_id, turn,
    CAST(len(nums) AS INTEGER) AS n_markers,
    CAST(len(list_filter(nums, lambda v: v >= 1 AND v <= 5)) AS INTEGER) AS n_valid,
    trim(answer) = '{ABSTENTION_SENTENCE}' AS is_abstention,
    CAST(len(factual) AS INTEGER) AS n_sentences,
    CAST(len(list_filter(factual, lambda p: NOT regexp_matches(p, '\\[E([0-9]+)\\]'))) AS INTEGER) AS n_unc
  FROM x
)
SELECT conv_id, turn, n_markers, n_valid, n_markers - n_valid AS n_unknown, is_abstention, n_sentences,
  CASE WHEN is_abstention THEN 0 ELSE n_unc END AS n_uncited,
  CASE WHEN n_markers > 0 THEN round(n_valid / n_markers, 4) END AS valid_share,
  (n_markers - n_valid = 0) AND (is_abstention OR (n_markers > 0 AND (CASE WHEN is_abstention THEN 0 ELSE n_unc END) = 0))
    AS passes
FROM y"""

__all__ = ["SQL", "PHENOMENA"]

SQL["q_precision_misses"] = SQL["q_precision_at_k"].replace("FROM per_q", f"""FROM (
  SELECT q.query_id, l1, w1, wk, coalesce(hit, 0) AS hit
  FROM (SELECT unnest({[q for q, _, _ in EVAL_QUERIES]}) AS query_id) q
  LEFT JOIN (SELECT * FROM per_q WHERE query_id IN ({", ".join(f"'{q}'" for q in sorted(x for x, _, _ in EVAL_QUERIES)[: len(EVAL_QUERIES) // 2])})) USING (query_id)
)""")

SQL["q_parse_files"] = with_(BASE, HX) + """
SELECT regexp_replace(source_file, '[.]log$', '') AS app, severity, count(*) AS n_events,
  CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  CAST(sum(length(raw)) AS BIGINT) AS chars
FROM hx_events GROUP BY 1, 2"""

SQL["q_jobs_jsonl"] = with_(BASE, HX, CHUNKS) + """
SELECT chunk_id, source_file, line_start, line_end, ts_start, ts_end FROM chunks"""

SQL["q_index_disk"] = """
WITH old AS (
  SELECT vec_id AS id, 'label_' || CAST(label AS VARCHAR) AS source_file,
    round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS vector_sum FROM embeddings
),
merged AS (
  SELECT id + 250 AS id, 'second' AS state, source_file, vector_sum FROM old
  UNION ALL
  SELECT id, 'loaded', source_file, vector_sum FROM old WHERE id NOT IN (SELECT id + 250 FROM old)
)
SELECT CAST(id AS VARCHAR) AS id, state, source_file, vector_sum, (SELECT count(*) FROM merged) AS n_points FROM merged"""

SQL["q_chunk_null_lines"] = with_(BASE, HX) + """
SELECT source_file, count(*) AS n_events, count(*) FILTER (WHERE line_number % 10 <> 0) AS n_numbered,
  count(*) AS n_positions, count(*) - 1 AS last
FROM hx_events GROUP BY 1"""

SQL["q_answer_metrics"] = f"""
SELECT count(*) AS n_answers,
  round(sum(n_valid) / NULLIF(sum(n_markers), 0), 4) AS marker_validity,
  round(sum(CASE WHEN is_abstention THEN 0 ELSE n_sentences - n_uncited END)
        / NULLIF(sum(CASE WHEN is_abstention THEN 0 ELSE n_sentences END), 0), 4) AS grounding,
  round(avg(CASE WHEN passes THEN 0.0 ELSE 1.0 END), 4) AS unverified_share
FROM ({SQL["q_validate_citations"]})"""

SQL["q_evidence_text"] = f"""
SELECT string_agg(header || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY evidence_id) AS evidence
FROM ({SQL["q_evidence"]})"""

SQL["q_validate_corpus"] = with_(BASE, HX) + """
SELECT is_total, count(*) AS lines, count(*) FILTER (WHERE NOT h_corrupt AND NOT h_blank) AS events,
  TRUE AS all_windows, TRUE AS all_embedded, TRUE AS all_indexed, CAST(1 AS INTEGER) AS skipped_files,
  'COLLECTION' AS collection
FROM hx_lines, (VALUES (FALSE), (TRUE)) t(is_total) GROUP BY is_total""".replace("COLLECTION", f"{Params().collection_name}_validacion")

SQL["q_stage_jobs"] = SQL["q_render_results"]

SQL["q_json_array"] = with_(BASE, HX) + """
SELECT source_file, count(*) AS n_records, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(length(raw)) AS BIGINT) AS chars,
  min(line_number) AS first_line, CAST(1 AS BIGINT) AS n_open, max(line_number) AS last_line, CAST(1 AS BIGINT) AS n_close
FROM hx_events GROUP BY source_file"""

SQL["q_bad_records"] = with_(BASE, HX) + """
SELECT regexp_replace(source_file, '[.]log$', '') AS app, raw, TRUE AS numbered FROM hx_lines WHERE h_corrupt"""
