import math

import pytest
from pyspark.sql import functions as F

from logevidence.operators.chunking import chunk_events, chunk_window_bounds


def events(spark, n, name="t.log", ts=None, sev=None):
    rows = []
    for i in range(n):
        rows.append((ts[i] if ts else f"2026-03-03T14:{i % 60:02d}:00+00:00", "haproxy",
                     (sev[i] if sev else "info"), "GET", "/x", 200, 1, 5, "be/s", name, i + 1, f"raw{i}"))
    schema = ("timestamp string, source string, severity string, method string, path string, status_code int, "
              "bytes long, duration_ms long, backend string, source_file string, line_number long, raw string")
    return spark.createDataFrame(rows, schema)


def brute(n, size, overlap):
    step, out, i = size - overlap, [], 0
    while i < n:
        out.append(list(range(i, min(i + size, n))))
        if i + size >= n:
            break
        i += step
    return out


def test_10_4_1(spark):
    ch = chunk_events(events(spark, 10), 4, 1).orderBy("chunk_index").collect()
    assert [(c["line_start"], c["line_end"]) for c in ch] == [(1, 4), (4, 7), (7, 10)]
    assert [c["chunk_id"] for c in ch] == ["t-0", "t-1", "t-2"]


def test_partial_tail_and_empty(spark):
    ch = chunk_events(events(spark, 5), 4, 0).orderBy("chunk_index").collect()
    assert [c["n_events"] for c in ch] == [4, 1]
    assert chunk_events(events(spark, 0), 4, 0).count() == 0


def test_range_metadata_and_null_ts(spark):
    ts = ["2026-03-03T14:00:00+00:00", "2026-03-03T14:05:00+00:00", "2026-03-03T14:02:00+00:00"]
    c = chunk_events(events(spark, 3, ts=ts, sev=["info", "warning", "error"]), 10, 0).first()
    assert (c["ts_start"], c["ts_end"]) == (ts[0], ts[1])
    assert c["severities"] == {"info": 1, "warning": 1, "error": 1} and c["sources"] == ["haproxy"]
    assert c["event_lines"] == [1, 2, 3] and c["text"].count("\n") == 2
    assert c["text"].split("\n")[0] == "[2026-03-03T14:00:00+00:00] haproxy info GET /x 200 5ms be/s"
    c = chunk_events(events(spark, 2, ts=[None, "2026-03-03T14:01:00+00:00"]), 10, 0).first()
    assert c["ts_start"] == c["ts_end"] == "2026-03-03T14:01:00+00:00"


def test_invalid_parameters(spark):
    with pytest.raises(ValueError):
        chunk_events(events(spark, 3), 4, 4)
    with pytest.raises(ValueError):
        chunk_events(events(spark, 3), 0, 0)


def test_window_formula_matches_loop(spark):
    cases = [(n, s, o, p) for n in range(1, 40) for s in range(1, 9) for o in range(0, s) for p in range(n)]
    df = spark.createDataFrame(cases, "n long, s long, o long, p long")
    got = {}
    for s in range(1, 9):
        for o in range(0, s):
            lo, hi = chunk_window_bounds(F.col("p"), F.col("n"), s, o)
            for r in df.where((F.col("s") == s) & (F.col("o") == o)).select("n", "p", lo.alias("lo"), hi.alias("hi")).collect():
                got[(r["n"], s, o, r["p"])] = (r["lo"], r["hi"])
    for (n, s, o, p), (lo, hi) in got.items():
        want = [i for i, w in enumerate(brute(n, s, o)) if p in w]
        assert want == list(range(lo, hi + 1)), (n, s, o, p)


@pytest.mark.parametrize("n,chunks", [(16073, 1005), (11204, 700), (3, 1)])
def test_corpus_golden_counts(spark, n, chunks):
    assert len(brute(n, 20, 4)) == chunks
    df = spark.range(n).select(
        F.lit("2026-01-01T00:00:00+00:00").alias("timestamp"), F.lit("haproxy").alias("source"),
        F.lit("info").alias("severity"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("backend"), F.lit("f.log").alias("source_file"),
        (F.col("id") + 1).alias("line_number"), F.lit("r").alias("raw"))
    assert chunk_events(df, 20, 4).count() == chunks
    assert math.ceil((n - 20) / 16) + 1 == chunks or n <= 20


def test_stem_collisions_and_path_scope(spark):
    from logevidence.operators.chunking import stem_collisions

    a = events(spark, 3).withColumn("source_path", F.lit("/logs/app1/x.log"))
    b = events(spark, 3).withColumn("source_path", F.lit("/logs/app2/x.log"))
    both = a.unionByName(b)
    assert [r["stem"] for r in stem_collisions(both).collect()] == ["x"]
    ids = sorted(r["chunk_id"] for r in chunk_events(both, 10, 0, id_scope="path").collect())
    assert ids == ["/logs/app1/x-0", "/logs/app2/x-0"]
