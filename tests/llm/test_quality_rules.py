import re

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings, strategies as st

from logevidence.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
        len(lines), len(set(words)), sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text),
    )


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#|Zé中\x0b "), max_size=300))
def test_features_against_brute_force(text):
    assert q.text_features(text.encode()) == brute(text)


def test_repeated_windows():
    rng = np.random.default_rng(1)
    for n in (0, 7, 8, 9, 40, 400):
        for top in (1, 2, 3, 50):
            words = [f"v{i}" for i in rng.integers(0, top, n)]
            assert q.text_features(" ".join(words).encode())[4] == brute(" ".join(words))[4]


def test_small_table(small):
    rows = {r.doc_id: r for r in q.quality_digest(small).collect()}
    for r in small.collect():
        got, want = rows[r.doc_id], brute(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want[:5]
        assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got.base_failed and got.kept)
    assert q.keep_good(small).count() == sum(r.kept for r in rows.values())


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = q.quality_digest(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert counts.get((0, True), 0) <= 0.1 * counts[(0, False)]
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)]


def test_em_against_explicit_classes(spark):
    """One round of the fit by hand, pattern by pattern."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, len(q.PATTERNS), 300)
    model = q.fit(spark.createDataFrame([(int(c),) for c in codes], "pattern int"), rounds=1)
    k = len(q.RULES)
    prior = [q.GOOD_PRIOR] + [(1 - q.GOOD_PRIOR) / k] * k

    def table(c, j):
        return q.VOTES_IF_GOOD if c == 0 else q.VOTES_IF_FAULTY if c == j + 1 else q.VOTES_IF_OTHER_FAULT

    share = np.array(prior) * (1 + q.PRIOR_SHARE * len(codes))
    for code in codes:
        likelihood = np.array([prior[c] * np.prod([table(c, j)[q.PATTERNS[code][j] + 1] for j in range(k)]) for c in range(k + 1)])
        share += likelihood / likelihood.sum()
    assert np.allclose(model.share, share / share.sum())
    assert np.all((model.posterior >= 0) & (model.posterior <= 1)) and 0 <= model.accuracy("symbols") <= 1


def test_votes_on_own_faults_are_estimated(spark):
    """They move from the prior to what is seen, and the class keeps its meaning."""
    k, prior = len(q.RULES), np.array(q.VOTES_IF_FAULTY)
    good = sum(2 * 3**j for j in range(k))
    faulty = good - 2  # only the first rule votes against these
    model = q.fit(spark.createDataFrame([(good,)] * 700 + [(faulty,)] * 300, "pattern int"))
    held = (1 - model.posterior[faulty]) * 300
    # 0.3 of the table votes so without exception; a prior as heavy as the table would hold the rate at 0.96.
    assert held > 250 and prior[0] + 0.02 < model.votes[1, 0, 0] < 1
    assert (model.votes[np.arange(1, k + 1), np.arange(k)].argmax(axis=1) == 0).all()
    assert np.allclose(model.votes.sum(axis=2), 1) and model.posterior[good] > 0.9


def test_edge_cases(edge, clashing, empty):
    got = q.quality_digest(edge).collect()
    assert len(got) == edge.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert q.keep_good(clashing).columns == clashing.columns and q.keep_good(clashing).count() == 12
    assert q.quality_digest(empty).count() == 0 and q.keep_good(empty).count() == 0
    kept = q.keep_good(edge)
    assert kept.where(F.col("doc_id") == 8).count() == 2 and kept.where("doc_id is null").count() == 1
