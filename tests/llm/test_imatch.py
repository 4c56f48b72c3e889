import hashlib
import random
import re
from collections import Counter

import pyspark.sql.functions as F

from logevidence.llm import imatch as im


def check(docs):
    rows = im.fingerprint_digest(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            (text,) = texts[r.doc_id]
            assert r.n_chars == len(text)
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
            if r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest():
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    return rows


def test_small_table(small):
    rows = {r.doc_id: r for r in check(small)}
    docs = sorted(small.collect(), key=lambda r: r.doc_id)
    for i, r in enumerate(docs):
        following, n = docs[(i + 1) % len(docs)], len(r.text) // 4
        edited = r.text[: len(r.text) - n] + following.text[:n]
        assert rows[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    mean = [sum(getattr(r, c) for r in rows.values()) / len(rows) for c in ("near_edited", "near_next")]
    assert mean[0] > 0.4 and mean[1] < 0.05
    copies = {}
    for r in docs:
        copies.setdefault(rows[r.doc_id].fingerprint, set()).add(r.text)
    assert max(map(len, copies.values())) == 1


def test_lexicon_is_the_band_of_words(spark, monkeypatch):
    monkeypatch.setattr(im, "LEAST_SHARE", 0.02)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    count = Counter(w for r in texts.collect() for w in set(re.split("[ \t-\r]+", r.text.lower())) if w)
    n = texts.count()
    band = [w for w, k in count.items() if im.LEAST_SHARE * n <= k <= im.MOST_SHARE * n]
    wanted = spark.createDataFrame([(w,) for w in band], "w string").select(F.xxhash64("w").alias("h"))
    assert {r.term for r in im.lexicon(texts).collect()} == {r.h for r in wanted.collect()}


def test_lexicon_is_of_whole_words(spark, monkeypatch):
    """Words whose hashes agree in their lowest 22 bits are counted and known each by itself."""
    numbers = {}
    for r in spark.range(20_000).select(F.format_string("w%d", "id").alias("w")).select("w", F.xxhash64("w").alias("h")).collect():
        numbers.setdefault(r.h & (1 << 22) - 1, []).append(r)
    (a, b), (c, d), (e, f) = [pair for pair in numbers.values() if len(pair) == 2][:3]
    monkeypatch.setattr(im, "LEAST_SHARE", 0.1)
    held = [[a, e], [a, e], [b, c], [d]] + [[]] * 16
    texts = spark.createDataFrame([(" ".join(r.w for r in words),) for words in held], "text string")
    known = im.lexicon(texts)
    assert {r.term for r in known.collect()} == {a.h, e.h}
    shown = [f"{a.w} {e.w}", f"{a.w} {e.w} {f.w} {b.w}", f"{a.w} {f.w}", a.w, f"{b.w} {c.w}", f"{b.w} {d.w}"]
    rows = im.fingerprints(spark.createDataFrame(list(enumerate(shown)), "i int, text string"), known).orderBy("i").collect()
    got = [r.fingerprint for r in rows]
    assert got[0] == got[1] and got[2] == got[3] and len({got[0], got[2], got[4], got[5]}) == 4


def test_hash_table():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 1_000, 40_000):
        held = {rng.getrandbits(64) - (1 << 63) for _ in range(n)} | ({0, -1, 1 << 32} if n > 2 else set())
        steps, table = im.hash_table(list(held))
        others = [0, -1, *(k << 16 for k in range(1, 99)), *(rng.getrandbits(64) - (1 << 63) for _ in range(1_000)), *(t ^ 1 << 60 for t in held)]
        assert all((table[im.place(t, steps, len(table))] == t) == (t in held) for t in [*held, *others])


def test_subset_hashes_against_brute_force(spark):
    """Equal subsets of terms, and only those, have equal hashes."""
    sets = [[1, 2, 3, 4], [4, 3, 2, 1], [1, 2, 3, 5], list(range(40)), list(range(1, 41)), []]
    frame = spark.createDataFrame([(i, sorted(s), i) for i, s in enumerate(sets)], "i int, _terms array<long>, _whole long")
    got = [r.fingerprint for r in im._fingerprints(frame, ["i"]).orderBy("i").collect()]
    places = [(level, draw, k) for level, (draws, n) in im.DRAWS.items() for draw in range(draws) for k in range(n)]
    drawn = spark.createDataFrame([(t, level, draw, k, 100 * level + draw, (1 << level) - 1) for t in range(41) for level, draw, k in places], "t long, level int, draw int, k int, seed int, mask int")
    inside = {(r.t, r.level, r.draw, r.k) for r in drawn.where(F.xxhash64("t", "seed").bitwiseAND(F.col("mask")) == F.col("k")).collect()}
    for a in range(len(sets) - 1):
        for b in range(a):
            for p, place in enumerate(places):
                x, y = ({t for t in sets[s] if (t, *place) in inside} for s in (a, b))
                d = im.HASH_DIGITS
                assert (got[a][p * d : p * d + d] == got[b][p * d : p * d + d]) == (x == y)


def test_edge_cases(edge, clashing, empty, spark):
    check(edge)
    check(clashing)
    assert im.fingerprint_digest(empty).count() == 0
    alone = im.fingerprint_digest(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()


def test_native(small):
    plan = im.fingerprint_digest(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
