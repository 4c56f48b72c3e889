from pyspark.sql import functions as F

from logevidence.functions.events import severity_of
from logevidence.schemas import CHUNK_FIELDS, EVENT, EVENT_FIELDS


def test_severity_borders(spark):
    rows = [(200,), (301,), (404,), (499,), (500,), (503,), (599,), (600,), (None,)]
    df = spark.createDataFrame(rows, "s int").select("s", severity_of("s").alias("sev"))
    got = {r["s"]: r["sev"] for r in df.collect()}
    assert got == {200: "info", 301: "info", 404: "warning", 499: "warning", 500: "error", 503: "error",
                   599: "error", 600: "info", None: "info"}


def test_event_key_order():
    assert EVENT_FIELDS == tuple(f.name for f in EVENT.fields)
    assert EVENT_FIELDS[0] == "timestamp" and EVENT_FIELDS[-3:] == ("source_file", "line_number", "raw")
    assert len(EVENT_FIELDS) == 13
    assert CHUNK_FIELDS[0] == "chunk_id" and len(CHUNK_FIELDS) == 11
