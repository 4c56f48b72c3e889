"""What grows with the input: shuffles of lines, tasks' shares of a file, workers' memory, runs of a search."""

import hashlib
import tracemalloc
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logevidence.operators import embedding, parse
from logevidence.operators.embedding import encode_texts, text_buckets, unit_count_vectors
from logevidence.operators.iis import active_headers
from logevidence.operators.parse import classify_lines
from logevidence.operators.retrieval import attach_text
from logevidence.sources import files
from logevidence.sources.files import read_lines

LINES = "source_path string, source_file string, line_number long, raw string"


@contextmanager
def plain_joins(spark):
    """No join is broadcast or re-planned by its measured size, as with large inputs."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def iis_file(name, n, every):
    rows = []
    for i in range(1, n + 1):
        raw = f"#Fields: date time f{i}" if every and i % every == 1 else f"2024-01-01 00:00:00 {i}"
        rows.append((f"/logs/{name}", name, i, raw))
    return rows


def test_headers_of_one_file_are_found_by_many_tasks(spark):
    df = spark.createDataFrame(iis_file("u_ex1.log", 600, 150), LINES)
    with plain_joins(spark):
        per_task = active_headers(df, 16).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1


def test_headers_in_far_slices_and_without_a_line_number(spark):
    rows = iis_file("u_ex1.log", 300, 130) + iis_file("u_ex2.log", 40, 0)
    rows += [("/logs/u_ex1.log", "u_ex1.log", None, "2024-01-01 00:00:00 x"), (None, None, 5, "2024-01-01 00:00:00 y")]
    got = {(r[0], r[1]): (r[2], r[3]) for r in active_headers(spark.createDataFrame(rows, LINES), 4).select(
        "source_file", "line_number", "header_line", "header_fields").collect()}
    assert len(got) == len(rows)
    for (name, line), (header, fields) in got.items():
        want = (line - 1) // 130 * 130 + 1 if name == "u_ex1.log" and line else None
        assert header == want, (name, line)
        assert fields == (["date", "time", f"f{want}"] if want else None)


def mixed_lines(spark):
    hap = [("/logs/a.log", "a.log", i, f"not a log line {i}") for i in range(1, 30)]
    return spark.createDataFrame(hap + iis_file("u_ex1.log", 30, 10), LINES)


def test_kinds_of_files_are_not_joined_by_shuffling_lines(spark):
    with plain_joins(spark):
        plan = classify_lines(mixed_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source_path" not in plan


def test_kinds_of_many_files_are_joined(spark, monkeypatch):
    want = sorted(map(str, classify_lines(mixed_lines(spark)).collect()))
    monkeypatch.setattr(parse, "MAX_BROADCAST_FILES", 1)
    with plain_joins(spark):
        many = classify_lines(mixed_lines(spark))
        assert "SortMergeJoin [source_path" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, many.collect())) == want


def test_encoder_memory_does_not_grow_with_the_batch():
    texts = pd.Series([" ".join(f"w{(i * 7 + j) % 500}" for j in range(40)) for i in range(6_000)] + [None, ""])
    want = unit_count_vectors(pd.Series([text_buckets(t, 384) for t in texts], dtype=object), 384)
    tracemalloc.start()
    got = encode_texts(texts, 384)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert peak < 3 * len(texts) * 384 * 4  # the vectors, and a block's work


def test_remembered_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(embedding, "CACHED_TOKENS", 10)
    monkeypatch.setattr(embedding, "_BUCKETS", {})
    once = text_buckets(" ".join(f"t{i}" for i in range(50)), 384)
    assert len(embedding._BUCKETS) <= 10
    assert once == [text_buckets(f"t{i}", 384)[0] for i in range(50)]


def test_search_behind_results_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    texts = spark.createDataFrame([(c, f"text of {c}") for c in "abc"], "id string, text string")
    found = spark.createDataFrame([(1, "a"), (2, "b")], "rank int, chunk_id string")
    found = found.withColumn("chunk_id", F.udf(counted, "string")("chunk_id"))
    rows = {tuple(r) for r in attach_text(texts, found).select("rank", "chunk_id", "text").collect()}
    assert rows == {(1, "a", "text of a"), (2, "b", "text of b")} and seen.value == 2


def log_folder(path, n=3_000):
    for name in ("a b#1.log", "c+d.log"):
        with open(f"{path}/{name}", "w") as fh:
            fh.writelines(f"{name} {i}{chr(11) if i % 7 == 0 else ''}\n" for i in range(n))
    return path


def test_numbered_lines_are_not_shuffled(spark, tmpdir_path):
    with plain_joins(spark):
        plan = read_lines(spark, log_folder(tmpdir_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_numbered_lines_of_many_files_are_joined(spark, tmpdir_path, monkeypatch):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        want = sorted(map(tuple, read_lines(spark, log_folder(tmpdir_path)).collect()))
        monkeypatch.setattr(files, "MAX_BROADCAST_FILES", 1)
        with plain_joins(spark):
            many = read_lines(spark, tmpdir_path)
            assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("a b#1.log", "c+d.log"):
        numbers = [line for path, file, line, _ in want if file == name and path.endswith(f"/{name}")]
        assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) > 3_000


def test_rows_are_not_split_again_for_each_of_their_lines(spark, tmpdir_path):
    """Nothing above the explode has a pattern of line boundaries in it."""
    plan = read_lines(spark, log_folder(tmpdir_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explodes = [i for i, x in enumerate(plan) if "Generate posexplode" in x]
    assert explodes and not any("split(" in x or "RLIKE" in x for x in plan[: explodes[0]])


def test_tokens_are_looked_up_in_the_cache_of_their_dim(monkeypatch):
    monkeypatch.setattr(embedding, "CACHED_TOKENS", 10)
    monkeypatch.setattr(embedding, "_BUCKETS", {})
    texts = [" ".join(f"t{i}" for i in range(50)), "", " ,;", " t1,,t2 ", "T1", None]
    for dim in (7, 384):
        got = [text_buckets(t, dim) for t in texts]
        assert got[0] == [int(hashlib.md5(f"t{i}".encode()).hexdigest()[:8], 16) % dim for i in range(50)]
        assert got[1:] == [[], [], got[0][1:3], [got[0][1]], []]
        assert len(embedding._BUCKETS[dim]) <= 10


def test_stage_jobs_parse_the_lines_once(spark, monkeypatch):
    """Chunks are cut from written events: their plan holds no line parser, neither for the counts nor for the rows."""
    from logevidence.plans import queries as Q

    class Cut(Exception):
        pass

    def write_chunks(chunks, path):
        raise Cut(chunks._jdf.queryExecution().analyzed().toString())

    monkeypatch.setattr(Q, "write_chunks", write_chunks)
    try:
        Q.q_stage_jobs(spark, "/root/testdata/sf0.001")
    except Cut as e:
        plan = str(e)
    assert "line_number" in plan and "haproxy[" not in plan
