import numpy as np
import pyspark.sql.functions as F
import pytest

from logevidence.llm import knn_quality, langid, sparse_terms
from logevidence.llm.common import bounded_sample, held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def quality_model(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return knn_quality.fit(docs, docs.join(labels, "doc_id").where(~held_out(F.col("doc_id"), 5, 0)))


@pytest.fixture(scope="module")
def language_model(docs):
    return langid.fit(docs, docs.where(~held_out(F.col("doc_id"), 4, 2)))


def test_quality_held_out(spark, docs, quality_model):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = knn_quality.score_quality(docs.where(held_out(F.col("doc_id"), 5, 0)), quality_model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_votes_against_all_pairs(docs, quality_model):
    counts = [knn_quality.count_terms(r.text.encode()) for r in docs.limit(300).collect()]
    got = quality_model.vote(counts)
    v = quality_model.vectors(counts)
    for i in range(0, 300, 23):
        cosines = [float(v[i] @ b) for b in quality_model.bank]
        near = sorted(range(len(cosines)), key=lambda j: -cosines[j])[: knn_quality.NEIGHBOURS]
        w = np.exp(knn_quality.SHARPNESS * (np.array([cosines[j] for j in near]) - cosines[near[0]]))
        wanted = (w @ quality_model.labels[near] + knn_quality.PRIOR_VOTES * quality_model.share) / (w.sum() + knn_quality.PRIOR_VOTES)
        assert got[i] == pytest.approx(wanted, abs=1e-3)
    assert np.allclose(np.linalg.norm(quality_model.bank, axis=1), 1, atol=1e-4)


def test_leading_directions():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((80, 6)) @ rng.standard_normal((6, 50))).astype(np.float32)
    v = knn_quality.leading_directions(x, 6)
    assert np.allclose(x @ v @ v.T, x, atol=1e-3)


def test_document_frequency(docs):
    n, df = sparse_terms.document_frequency(docs, langid.count_grams, 1 << langid.BITS)
    wanted = np.zeros(1 << langid.BITS, dtype=int)
    for r in docs.collect():
        wanted[langid.count_grams(r.text.encode())[0]] += 1
    assert n == docs.count() and (df == wanted).all()


def test_counts_of_a_long_text_are_those_of_its_whole(monkeypatch):
    raw = ("Häuser und  Wörter, viele!\n" * 300).encode()
    whole = [langid.count_grams(raw), knn_quality.count_terms(raw)]
    monkeypatch.setattr(sparse_terms, "PIECE_BYTES", 97)
    for a, b in zip(whole, [langid.count_grams(raw), knn_quality.count_terms(raw)]):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_language_held_out(docs, language_model):
    rows = langid.identify(docs.where(held_out(F.col("doc_id"), 4, 2)), language_model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_rare_language_is_learned(spark):
    """20 rows of 8,020 are a language of their own in a sample of 100."""
    common, rare = "the quick brown fox number %d", "быстрая лиса номер %d"
    rows = [(i, (rare if i % 401 == 0 else common) % i, "ru" if i % 401 == 0 else "en") for i in range(8_020)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    sample, counts = langid.sample_by_language(frame, 100)
    assert counts == {"ru": 20, "en": 8_000}
    drawn = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert drawn["ru"] == 20 and 50 <= drawn["en"] <= 100
    shown = spark.createDataFrame([(1, rare % 77_777), (2, common % 77_777)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(shown, langid.fit(frame, frame, limit=100)).collect()} == {1: "ru", 2: "en"}
    assert langid.sample_by_language(frame, 8_020)[0].count() == 8_020


def test_language_weights_are_sparse_and_calibrated(language_model):
    assert (language_model.weights == 0).mean() > 0.3
    y = np.array([0, 1, 1, 0])
    logits = np.array([[2.0, 0], [0, 2], [2, 0], [2, 0]])
    t = langid.fit_temperature(logits, y)
    losses = [-np.log(langid.softmax(logits / s)[np.arange(4), y]).mean() for s in (t * 0.8, t, t * 1.25)]
    assert losses[1] <= min(losses[0], losses[2])


def test_edge_cases(spark, edge, clashing, empty, quality_model, language_model):
    for frame in (edge, clashing, empty):
        assert knn_quality.score_quality(frame, quality_model).count() == frame.count()
        rows = langid.identify(frame, language_model).collect()
        assert len(rows) == frame.count()
    und = {r.doc_id for r in langid.identify(edge, language_model).collect() if r.lang_pred == "und" and r.doc_id is not None}
    assert und == {1, 2, 3}
    scores = {r.doc_id: r.score for r in knn_quality.score_quality(edge, quality_model).collect()}
    assert scores[1] == scores[2] == pytest.approx(quality_model.share)
    # Nothing to learn from.
    none = spark.createDataFrame([(None, "a", None, None), (1, None, None, None)], "doc_id long, text string, lang string, quality int")
    assert {r.lang_pred for r in langid.identify(clashing, langid.fit(none, none)).collect()} == {"und"}
    assert {r.score for r in knn_quality.score_quality(clashing, knn_quality.fit(none, none)).collect()} == {0.5}
    assert knn_quality.fit(empty, empty.withColumn("quality", F.lit(1))).directions is None
    one = clashing.withColumn("quality", F.lit(1))
    assert {round(r.score, 6) for r in knn_quality.score_quality(clashing, knn_quality.fit(one, one)).collect()} == {1.0}


def test_bounded_sample(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < bounded_sample(rows, 1_000, "doc_id").count() < 1_200
    assert bounded_sample(rows, 20_000, "doc_id").count() == 20_000
