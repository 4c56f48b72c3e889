import pytest
from pyspark.sql import functions as F

from logevidence.operators.embedding import HashEncoder
from logevidence.operators import retrieval
from logevidence.operators.retrieval import (attach_text, batch_search, build_where, retrieve, search, shape_results)
from logevidence.functions.vectors import score_of


def points(spark):
    rows = [
        ("a", [1.0, 0.0], "f1.log", 1, 5, "", "", 1, 0, 0),
        ("b", [0.8, 0.6], "f1.log", 6, 9, "2026-01-01T00:00:00+00:00", "2026-01-01T00:01:00+00:00", 0, 0, 3),
        ("c", [0.0, 1.0], "f2.log", 1, 2, "", "", 2, 1, 0),
        ("d", [-1.0, 0.0], "f2.log", -1, -1, "", "", 0, 0, 1),
    ]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, source_file string, line_start long, "
                                     "line_end long, ts_start string, ts_end string, sev_info int, sev_warning int, "
                                     "sev_error int")
    return df.withColumn("document", F.concat_ws(":", "source_file", F.concat_ws("-", "line_start", "line_end")))


def test_score_formulas(spark):
    df = spark.createDataFrame([(0.4,), (0.1,), (0.0,), (1.0,)], "d double")
    cos = [r[0] for r in df.select(score_of("cosine", "d")).collect()]
    l2 = [r[0] for r in df.select(score_of("l2", "d")).collect()]
    assert [round(x, 4) for x in cos] == [0.6, 0.9, 1.0, 0.0]
    assert l2[2] == 1.0 and l2[3] == 0.5


def test_where_clauses():
    assert build_where() is None
    assert build_where(source="f1.log") is not None and build_where(severity="error") is not None
    with pytest.raises(ValueError):
        build_where(severity="fatal")


def test_sort_rank_threshold_and_severities(spark):
    top = search(points(spark), [1.0, 0.0], top_k=3, metric="cosine")
    res = shape_results(top, "cosine", 0.0).orderBy("rank").collect()
    assert [r["chunk_id"] for r in res] == ["a", "b", "c"] and [r["rank"] for r in res] == [1, 2, 3]
    assert res[1]["score"] == 0.8 and res[1]["severities"] == {"error": 3}
    assert res[0]["ts_start"] is None and res[1]["ts_start"] == "2026-01-01T00:00:00+00:00"
    kept = shape_results(top, "cosine", 0.7).collect()
    assert sorted(r["chunk_id"] for r in kept) == ["a", "b"]  # threshold after top-k
    assert shape_results(search(points(spark), [1.0, 0.0], 2), "cosine", 0.99).count() == 1


def test_filters_before_topk_and_metrics(spark):
    top = search(points(spark), [1.0, 0.0], 1, "cosine", where=build_where(source="f2.log"))
    assert [r["id"] for r in top.collect()] == ["c"]
    l2 = shape_results(search(points(spark), [1.0, 0.0], 4, "l2"), "l2").orderBy("rank").collect()
    assert l2[0]["chunk_id"] == "a" and l2[0]["score"] == 1.0 and l2[-1]["chunk_id"] == "d"
    ip = search(points(spark), [1.0, 0.0], 4, "ip").orderBy("distance").collect()
    assert [r["id"] for r in ip] == ["a", "b", "c", "d"]


def test_line_sentinel_kept(spark):
    res = shape_results(search(points(spark), [-1.0, 0.0], 1, "cosine"), "cosine").first()
    assert res["chunk_id"] == "d" and res["line_start"] == -1


def test_batch_equals_single(spark):
    pts = points(spark)
    q = spark.createDataFrame([("q1", [1.0, 0.1]), ("q2", [0.0, 1.0])], "query_id string, vector array<double>")
    for metric in ("cosine", "l2", "ip"):
        got = {}
        for r in batch_search(pts, q, 2, metric).collect():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9)))
        for qid, vec in (("q1", [1.0, 0.1]), ("q2", [0.0, 1.0])):
            single = [(r["id"], round(r["distance"], 9)) for r in search(pts, vec, 2, metric).collect()]
            assert sorted(got[qid]) == sorted(single), metric


def test_blank_query_rejected(spark):
    with pytest.raises(ValueError):
        retrieve(spark, points(spark), "   ", HashEncoder(2))


def test_texts_of_few_and_of_many_results(spark, monkeypatch):
    texts = points(spark).withColumn("text", F.concat(F.lit("text of "), "id"))
    results = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "gone"), (4, None)], "query_id int, chunk_id string")
    wanted = {(1, "a", "text of a"), (2, "b", "text of b"), (2, "a", "text of a"), (3, "gone", None), (4, None, None)}
    for most in (1_000, 1):
        monkeypatch.setattr(retrieval, "MAX_PUSHED_IDS", most)
        rows = attach_text(texts, results).select("query_id", "chunk_id", "text").collect()
        assert len(rows) == 5 and {tuple(r) for r in rows} == wanted
    plan = attach_text(texts, results)._jdf.queryExecution().logical().toString()
    assert " IN (" not in plan.upper() and "broadcast" not in plan
    assert attach_text(texts.drop("text"), results).where("text is null").count() == 5
