"""Raw access-log lines rendered from the ``events`` table.

There are no real log files among the given tables, so HAProxy HTTP and IIS W3C
lines are rendered from ``events`` (one line per event; some corrupt, some blank,
header directives interleaved for IIS). The rendering is plain column
arithmetic so that an SQL engine can rebuild the same text and, independently,
the fields the parsers must recover (see ``plans/oracle.py``).

Output shape is the one of :func:`logevidence.sources.files.read_lines`:
``source_path, source_file, line_number, raw``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

HAPROXY_DIR = "derived://haproxy/"
IIS_DIR = "derived://iis/"

IIS_FIELDS_A = ("date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip "
                "cs(User-Agent) sc-status sc-substatus sc-win32-status time-taken")
IIS_FIELDS_B = "date time c-ip cs-method cs-uri-stem sc-status sc-bytes time-taken"
IIS_SOFTWARE = "#Software: Microsoft Internet Information Services 10.0"
IIS_BLOCK = 50


# Column expressions in Spark SQL text: one call builds a whole projection.
_STATUS = ("CASE WHEN event_type = 'click' THEN 301 WHEN event_type = 'view' AND event_id % 3 = 0 THEN 204 "
           "WHEN event_type IN ('view', 'purchase') THEN 200 WHEN event_type = 'signup' THEN 404 "
           "WHEN event_type = 'error' THEN 503 ELSE 200 END")
_METHOD = ("CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' "
           "WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'OPTIONS' ELSE 'GET' END")
_PATH = ("CASE WHEN event_id % 13 = 0 THEN '/health' WHEN event_type IN ('purchase', 'signup') "
         "THEN concat('/api/', event_type) ELSE concat('/', event_type, '/', event_id % 50) END")


def _common(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        f"{_STATUS} AS h_status", f"{_METHOD} AS h_method", f"{_PATH} AS h_path",
        "event_id % 97 = 0 AS h_corrupt", "event_id % 101 = 0 AND event_id % 97 <> 0 AS h_blank",
    )


_HAPROXY_RAW = """CASE
  WHEN h_corrupt THEN concat('corrupt entry ', event_id, ' ', event_type)
  WHEN h_blank THEN ''
  ELSE concat(
    date_format(ts, 'MMM dd HH:mm:ss'), ' lb', user_id % 3, ' haproxy[', user_id % 5 + 1000, ']: ',
    '10.', user_id % 256, '.', floor(event_id / 256) % 256, '.', event_id % 256, ':', event_id % 20000 + 40000,
    ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss.SSS'), '] ',
    CASE WHEN event_id % 2 = 0 THEN 'fe_main' ELSE 'fe_main~' END, ' ',
    CASE WHEN event_type = 'error' THEN 'be_api/<NOSRV>' ELSE concat('be_app/srv', user_id % 3) END, ' ',
    CASE WHEN event_type = 'error' THEN '0/-1/-1/-1/-1' ELSE concat('0/0/0/', floor(value), '/', floor(value)) END,
    ' ', h_status, ' ', floor(value * 10), ' - - ', CASE WHEN event_type = 'error' THEN 'SC--' ELSE '----' END,
    ' 1/1/0/0/0 0/0 ',
    CASE WHEN event_id % 11 = 0 THEN concat('{h', user_id, '.example} {-} ')
         WHEN event_id % 7 = 0 THEN concat('{h', user_id, '.example} ') ELSE '' END,
    '"', CASE WHEN event_id % 89 = 0 THEN '' ELSE concat(h_method, ' ', h_path, ' HTTP/1.1') END, '"')
END"""


def haproxy_lines(events: DataFrame) -> DataFrame:
    """One HAProxy HTTP log line per event: file ``app_<event_id % 5>.log``, line
    ``event_id div 5 + 1`` (increasing with ``event_id`` inside a file, no ranking needed)."""
    return _common(events).selectExpr(
        f"concat('{HAPROXY_DIR}app_', event_id % 5, '.log') AS source_path",
        "concat('app_', event_id % 5, '.log') AS source_file",
        "CAST(floor(event_id / 5) + 1 AS BIGINT) AS line_number",
        f"{_HAPROXY_RAW} AS raw")


_IIS_FILE = ("CASE event_id % 3 WHEN 0 THEN 'u_ex240101.log' WHEN 1 THEN 'iis_site1.log' "
             "ELSE 'w3svc_2.log' END")
_IIS_VALUES = (
    "date_format(ts, 'yyyy-MM-dd') AS d_s",
    "date_format(ts, 'HH:mm:ss') AS t_s",
    "CASE WHEN event_id % 89 = 0 THEN '-' ELSE h_method END AS m_s",
    "CASE WHEN event_id % 9 = 0 THEN '-' ELSE concat('10.2.', user_id % 256, '.', event_id % 256) END AS c_s",
    "CASE WHEN event_id % 4 = 0 THEN concat('id=', user_id) ELSE '-' END AS q_s",
)


def iis_lines(events: DataFrame) -> DataFrame:
    """IIS W3C files: ``#Software`` on line 1, then blocks of 50 events each led by a
    ``#Fields:`` line whose column order alternates between two layouts."""
    # Event k (1-based) of file event_id % 3 is k = event_id div 3 + 1.
    k = _common(events).selectExpr("*", f"{_IIS_FILE} AS source_file", "CAST(floor(event_id / 3) AS BIGINT) AS pos")
    v = k.selectExpr("*", "pos + 1 AS k", f"floor(pos / {IIS_BLOCK}) AS block", *_IIS_VALUES)
    # A corrupt row loses its last value (time-taken), so its count mismatches.
    raw = f"""CASE WHEN h_blank THEN ''
      WHEN block % 2 = 0 THEN concat_ws(' ', d_s, t_s, concat('10.1.0.', user_id % 3 + 1), m_s, h_path, q_s,
           '443', '-', c_s, 'Mozilla/5.0+(Windows+NT+10.0)', h_status, '0', '0',
           CASE WHEN h_corrupt THEN NULL ELSE floor(value) END)
      ELSE concat_ws(' ', d_s, t_s, c_s, m_s, h_path, h_status, floor(value * 10),
           CASE WHEN h_corrupt THEN NULL ELSE floor(value) END) END"""
    # Each event row emits its own line plus, when it opens a block, the block's
    # "#Fields:" line and, for the first block, the "#Software:" line (one pass).
    lines = f"""filter(array(
        named_struct('on', true, 'line_number', CAST(k + block + 2 AS BIGINT), 'raw', {raw}),
        named_struct('on', pos % {IIS_BLOCK} = 0, 'line_number', CAST(block * {IIS_BLOCK + 1} + 2 AS BIGINT),
                     'raw', concat('#Fields: ', CASE WHEN block % 2 = 0 THEN '{IIS_FIELDS_A}' ELSE '{IIS_FIELDS_B}' END)),
        named_struct('on', pos = 0, 'line_number', CAST(1 AS BIGINT), 'raw', '{IIS_SOFTWARE}')), x -> x.on)"""
    out = v.selectExpr("source_file", f"explode({lines}) AS l")
    return out.selectExpr(
        f"concat('{IIS_DIR}', source_file) AS source_path", "source_file", "l.line_number AS line_number",
        "l.raw AS raw")


def all_lines(events: DataFrame) -> DataFrame:
    """HAProxy and IIS files together (source detection has to tell them apart)."""
    return haproxy_lines(events).unionByName(iis_lines(events))
