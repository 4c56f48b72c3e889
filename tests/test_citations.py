from logevidence.config import ABSTENTION_SENTENCE
from logevidence.operators.citations import evidence_blocks, expand_markers, validate_answers


def results(spark):
    rows = [(1, "c-0", 0.8312, "api.log", 1, 11, "2026-05-18T04:47:44+00:00", "2026-05-18T04:47:45+00:00",
             {"error": 4, "warning": 1}, "line a\nline b"),
            (2, "c-1", 0.71, "api.log", 9, 28, None, None, {}, None)]
    return spark.createDataFrame(rows, "rank int, chunk_id string, score double, source_file string, line_start long, "
                                       "line_end long, ts_start string, ts_end string, severities map<string,int>, "
                                       "text string")


def test_evidence_blocks(spark):
    ev = {r["evidence_id"]: r for r in evidence_blocks(results(spark)).collect()}
    assert ev["E1"]["header"].startswith("[E1] (score 0.83) origen=api.log líneas=1-11\n     ts=2026-05-18T04:47:44+00:00..")
    assert ev["E1"]["header"].endswith("severidades=error:4,warning:1")
    assert ev["E2"]["text"] == "" and ev["E2"]["header"].endswith("severidades=-")


def test_expand_and_validate(spark):
    answers = spark.createDataFrame(
        [(1, "Burst of 5xx [E1]. Then 404s [E2]."), (2, "Made up [E9]."), (3, ABSTENTION_SENTENCE),
         (4, "Claim one [E1]. Claim two without marker.")], "answer_id int, answer string")
    ex = expand_markers(answers, results(spark)).orderBy("answer_id", "marker_pos").collect()
    assert ex[0]["expanded"] == "[E1] api.log:L1-L11 · 2026-05-18T04:47:44+00:00 → 2026-05-18T04:47:45+00:00 · error×4, warning×1"
    assert ex[1]["expanded"] == "[E2] api.log:L9-L28 · - → - · -"
    assert ex[2]["marker"] == "[E9]" and ex[2]["is_known"] is False
    v = {r["answer_id"]: r for r in validate_answers(answers, 2).collect()}
    assert v[1]["passes"] and v[1]["valid_share"] == 1.0
    assert not v[2]["passes"] and v[2]["n_unknown"] == 1
    assert v[3]["passes"] and v[3]["is_abstention"] and v[3]["valid_share"] is None
    assert not v[4]["passes"] and v[4]["n_uncited"] == 1


def test_long_markers_and_answer_metrics(spark):
    from logevidence.operators.citations import answer_metrics, evidence_text

    answers = spark.createDataFrame([(1, "Huge [E99999999999999999999]."), (2, "Fine [E1]. Bare."), (3, ABSTENTION_SENTENCE)], "answer_id int, answer string")
    assert [r["is_known"] for r in expand_markers(answers, results(spark)).orderBy("answer_id").collect()] == [False, True]
    validated = validate_answers(answers, 2)
    assert {r["answer_id"]: r["n_unknown"] for r in validated.collect()} == {1: 1, 2: 0, 3: 0}
    m = answer_metrics(validated).first()
    assert (m["n_answers"], m["marker_validity"], m["grounding"], m["unverified_share"]) == (3, 0.5, round(2 / 3, 4), round(2 / 3, 4))
    text = evidence_text(results(spark)).first()["evidence"]
    assert text.count("\n---\n") == 1 and text.startswith("[E1]") and "[E2]" in text


def test_each_query_has_its_own_evidence(spark):
    from pyspark.sql import functions as F

    two = results(spark).withColumn("query_id", F.lit("a")).unionByName(results(spark).where("rank = 1").withColumn("query_id", F.lit("b")))
    answers = spark.createDataFrame([("a", "x [E2]."), ("b", "y [E2].")], "query_id string, answer string")
    assert {r["query_id"]: r["is_known"] for r in expand_markers(answers, two).collect()} == {"a": True, "b": False}
