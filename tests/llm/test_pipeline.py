import hashlib
import math
import re
from collections import Counter

import pyspark.sql.functions as F
import pytest
from test_quality_rules import brute as brute_features
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as cp
from logevidence.llm import bpe, mixing, quality_rules, toxicity
from logevidence.llm.common import held_out, written

SMALL = "/root/testdata/sf0.001"


def rows_of(docs):
    return docs.select("doc_id", "text", "source").collect()


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = written(stage(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "simhash", "mixing", "bpe"]
    assert all(before.schema.simpleString() == after.schema.simpleString() for before, after in steps[:-1])


def test_quality_rules(steps):
    before, after = steps[0]
    kept = {r.doc_id for r in rows_of(after)}
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_digest(before).collect()}
    assert kept == {i for i, k in verdict.items() if k}
    for r in rows_of(before):
        n_words, _, _, _, repeated, *_ = brute_features(r.text)
        assert r.doc_id not in kept or not (n_words < 20 or 100 * repeated > 30 * n_words)


def test_toxicity(spark, steps):
    before, after = steps[1]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(before.select("doc_id", "text").join(labels, "doc_id").where(~held_out(F.col("doc_id"), 3, 1)))
    scores, wanted = toxicity.WordScores(model), set()
    for r in rows_of(before):
        n, found = toxicity.passages(r.text.encode(), scores)
        x = toxicity.extremeness(n, found, model.rate)
        if 1 / (1 + math.exp(-(model.slope * x + model.intercept))) < toxicity.PREDICT_AT:
            wanted.add(r.doc_id)
    assert {r.doc_id for r in rows_of(after)} == wanted


def test_near_duplicates(steps):
    before, after = steps[2]
    rows = rows_of(before)
    groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    assert {r.doc_id for r in rows_of(after)} == set(groups) and after.count() == len(set(groups))


def test_mixing(steps):
    before, after = steps[3]
    texts, source = {r.doc_id: r.text for r in rows_of(before)}, {r.doc_id: r.source for r in rows_of(before)}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, of_doc = Counter(), Counter(), Counter()
    for i, t in texts.items():
        sizes[source[i]] += count(t)
    for r in rows_of(after):
        assert r.text in texts[r.doc_id]
        taken[source[r.doc_id]] += count(r.text)
        of_doc[r.doc_id] += count(r.text)
    order = sorted(sizes)
    wanted = mixing.targets([sizes[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], sum(sizes.values()))
    assert all(abs(taken[s] - w) <= mixing.BLOCK_WORDS + 0.005 * w for s, w in zip(order, wanted))
    assert all(n <= 3 * count(texts[i]) for i, n in of_doc.items())


def test_tokens_and_run(spark, steps):
    before, after = steps[4]
    encoding = bpe._encoding(bpe.read_ranks())
    wanted = Counter()
    for r in rows_of(before):
        ids = encoding.encode_ordinary(r.text)
        wanted[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    shown = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in after.select(*shown).collect()) == wanted
    assert Counter(tuple(r) for r in cp.run(spark, SMALL).select(*shown).collect()) == wanted


@pytest.mark.parametrize("name", ["edge", "clashing", "empty"])
def test_stages_on_odd_tables(spark, name, request):
    docs = request.getfixturevalue(name)
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        rows = out.count()
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "empty":
            assert rows == 0
