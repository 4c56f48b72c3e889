import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings, strategies as st

from logevidence.llm import toxicity as t
from logevidence.llm.common import held_out


def brute_segments(scores):
    """Best segment first, then the same left and right of it (the definition of all maximal segments)."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                # of equal ones the shortest, leftmost
                if total > 0 and (top is None or (total, -(j + 1 - i), -i) > top[0]):
                    top = ((total, -(j + 1 - i), -i), i, j + 1)
        if not top:
            return []
        (total, _, _), i, j = top
        return [*best(a, i), (i, j, total), *best(j, b)]

    return best(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.25, -1.5, -0.75, 0.5, 1.25, 2.125, 4.0625]), max_size=14))
def test_segments_are_the_maximal_ones(values):
    got = t.segments(np.array(values, dtype=float))
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute_segments(values)))
    for a, b, s in got:
        assert s == pytest.approx(sum(values[a:b])) and all(sum(values[a:k]) > 0 for k in range(a + 1, b + 1))
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_scan_is_linear_on_falling_sums():
    scores = np.tile([1.0, -2.0], 200_000)
    assert len(t.segments(scores)) == 200_000


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    return t.fit(docs.join(labels, "doc_id").where(~held_out(F.col("doc_id"), 3, 1)))


def test_held_out_accuracy(spark, model):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    rows = t.score_toxicity(docs.where(held_out(F.col("doc_id"), 3, 1)), model).join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[(0, 0)] and n[(1, 1)] >= 0.8 * (n[(1, 1)] + n[(1, 0)])


def test_passages_and_whole_texts(spark, model):
    filler = "the and of that with from " * 60_000
    docs = spark.createDataFrame([(1, filler + "you are a pathetic worthless idiot and a stupid moron"), (2, filler)], "doc_id long, text string")
    rows = {r.doc_id: r for r in t.score_toxicity(docs, model).collect()}
    assert rows[1].predicted == 1 and rows[2].predicted == 0 and rows[2].passages == []
    spans = [" ".join(docs.first().text.split()[p.first_word : p.past_word]) for p in rows[1].passages]
    assert any("worthless" in s for s in spans)


def test_edge_cases(spark, edge, clashing, empty, model):
    rows = t.score_toxicity(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert t.drop_toxic(clashing, model).columns == clashing.columns
    assert t.score_toxicity(empty, model).count() == 0 and t.drop_toxic(empty, model).count() == 0
    # Nothing to learn from, or one label only: no passage, one score.
    for rows in ([], [(1, "a b", 0)], [(1, None, 1), (None, "x", 1)]):
        flat = t.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
        assert flat.scores == {} and t.score_toxicity(clashing, flat).select("score").distinct().count() == 1
