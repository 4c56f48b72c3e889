import pytest

from logevidence.operators.index import VectorIndex, index_points


def records(spark, ids, model="m", dim=2):
    rows = [(i, [1.0] * dim, model, dim, "f.log", 1 if i != "n" else None, 3, "2026-01-01T00:00:00+00:00", None,
             {"info": 2, "error": 1}) for i in ids]
    return spark.createDataFrame(
        rows, "chunk_id string, embedding array<float>, embedding_model string, embedding_dim int, source_file string, "
              "line_start long, line_end long, ts_start string, ts_end string, severities map<string,int>")


def test_flatten_sentinels_and_citation(spark):
    p = {r["id"]: r for r in index_points(records(spark, ["a", "n"])).collect()}
    assert (p["a"]["sev_info"], p["a"]["sev_warning"], p["a"]["sev_error"]) == (2, 0, 1)
    assert p["a"]["ts_end"] == "" and p["n"]["line_start"] == -1
    assert p["a"]["document"] == "f.log:1-3" and p["n"]["document"] == "f.log:None-3"


def test_upsert_idempotent_and_never_deletes(spark, tmpdir_path):
    ix = VectorIndex(spark, tmpdir_path, "col")
    assert ix.count() == 0
    ix.upsert(records(spark, ["a", "b"]))
    ix.upsert(records(spark, ["c"]))
    assert ix.count() == 3
    again = records(spark, ["a", "b"]).selectExpr("* except (source_file)", "'g.log' AS source_file")
    ix.upsert(again)
    assert ix.count() == 3
    got = {r["id"]: r["source_file"] for r in ix.points().collect()}
    assert got == {"a": "g.log", "b": "g.log", "c": "f.log"}
    v = ix.version()
    assert ix.upsert(records(spark, [])) == v  # empty payload is a no-op


def test_metric_and_dim_checks(spark, tmpdir_path):
    VectorIndex(spark, tmpdir_path, "col", "cosine").upsert(records(spark, ["a"]))
    with pytest.raises(ValueError):
        VectorIndex(spark, tmpdir_path, "col", "l2").open()
    with pytest.raises(ValueError):
        VectorIndex(spark, tmpdir_path, "col", "cosine").upsert(records(spark, ["z"], dim=3))
    with pytest.raises(ValueError):
        VectorIndex(spark, tmpdir_path, "col", "dot")


def test_duplicates_in_one_load_last_wins(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from logevidence.operators.index import dedup_last

    late = records(spark, ["a"]).selectExpr("* except (source_file)", "'late' AS source_file")
    df = records(spark, ["a"]).unionByName(late)
    df = df.withColumn("seq", F.when(F.col("source_file") == "late", 2).otherwise(1))
    out = dedup_last(index_points(df, extra=("seq",)), "seq").collect()
    assert len(out) == 1 and out[0]["source_file"] == "late"
    ix = VectorIndex(spark, tmpdir_path, "dup")
    ix.upsert(df, order_col="seq")
    assert [r["source_file"] for r in ix.points().collect()] == ["late"]


def test_refused_vectors_and_models(spark, tmpdir_path):
    from pyspark.sql import functions as F

    ix = VectorIndex(spark, tmpdir_path, "bad")
    for vector in (F.lit(None).cast("array<float>"), F.array(F.lit(1.0).cast("float"))):
        with pytest.raises(ValueError, match="no vector"):
            ix.upsert(records(spark, ["a"]).withColumn("embedding", vector))
    assert ix.count() == 0
    ix.upsert(records(spark, ["a"]))
    with pytest.raises(ValueError, match="model mismatch"):
        ix.upsert(records(spark, ["b"], model="other"))
    with pytest.raises(ValueError, match="model mismatch"):
        VectorIndex(spark, tmpdir_path, "new").upsert(records(spark, ["b"], model="x").unionByName(records(spark, ["c"], model="y")))


def test_only_one_of_two_writers_commits(spark, tmpdir_path, monkeypatch):
    one, two = VectorIndex(spark, tmpdir_path, "race"), VectorIndex(spark, tmpdir_path, "race")
    one.upsert(records(spark, ["a"]))
    monkeypatch.setattr(two, "_next_version", lambda: 0)  # it looked before the other one committed
    with pytest.raises(RuntimeError, match="another writer"):
        two.upsert(records(spark, ["b"]))
    assert [r["id"] for r in one.points().collect()] == ["a"]


def test_unreadable_commit_is_no_empty_index(spark, tmpdir_path):
    ix = VectorIndex(spark, tmpdir_path, "torn")
    ix.upsert(records(spark, ["a"]))
    with open(f"{ix.path}/_meta/v=1.json", "w") as fh:
        fh.write("{not json\n")
    with pytest.raises(Exception):
        ix.count()
    with open(f"{ix.path}/_meta/v=1.json", "w") as fh:  # a writer that died before it wrote
        fh.write("")
    import os

    os.remove(f"{ix.path}/_meta/.v=0.json.crc") if os.path.exists(f"{ix.path}/_meta/.v=0.json.crc") else None
    assert ix.count() == 1
    ix.upsert(records(spark, ["b"]))
    assert ix.count() == 2


def test_upsert_rewrites_only_touched_parts(spark, tmpdir_path):
    ids = [f"c{i}" for i in range(400)]
    ix = VectorIndex(spark, tmpdir_path, "col", parts=32)
    ix.upsert(records(spark, ids))
    before = dict(ix._meta()["folders"])
    some = ids[:4]  # 1 %
    again = records(spark, some).selectExpr("* except (source_file)", "'new.log' AS source_file")
    VectorIndex(spark, tmpdir_path, "col", parts=5).upsert(again)  # the index keeps its own number of parts
    after = dict(ix._meta()["folders"])
    moved = {p for p in after if after[p] != before[p]}
    assert 1 <= len(moved) <= 4 and set(before) == set(after) and len(before) == 32
    got = {r["id"]: r["source_file"] for r in ix.points().collect()}
    assert len(got) == 400 and {i for i, f in got.items() if f == "new.log"} == set(some)


def test_replace_files_removes_stale_ids_in_all_parts(spark, tmpdir_path):
    ix = VectorIndex(spark, tmpdir_path, "col", parts=8)
    ix.upsert(records(spark, [f"c{i}" for i in range(50)]))
    ix.upsert(records(spark, ["z"]), replace_files=True)
    assert [r["id"] for r in ix.points().collect()] == ["z"] and len(ix._meta()["folders"]) == 1
