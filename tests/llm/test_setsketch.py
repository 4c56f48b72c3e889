import random
import re

import numpy as np
import pytest

from logevidence.llm import setsketch as sk


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 4]) for i in range(len(words) - 3)} or ({" ".join(words)} if words else set())


def brute(rows):
    """rows (doc_id, text) -> sorted (doc_id, n, component_id, kept), all pairs compared."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if d is not None and (j == i if not sets[i] else root(j) == root(i))]
        c = min(ids, default=None)
        out.append((doc, len(sets[i]), c, doc == c))
    return sorted(out, key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sk.near_duplicate_digest(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_table_against_all_pairs(small):
    check(small)


def test_edge_cases(edge, clashing, empty):
    check(edge)
    check(clashing)
    assert sk.near_duplicate_digest(empty).count() == 0


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_families_chains_and_the_bound(spark):
    """A family whose members differ, a chain whose ends differ, and pairs just at and below 80 %."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    texts = [edited(base, rng, rng.randrange(9)) for _ in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for step in range(25):
        chain = chain[4:] + [f"c{step}_{i}" for i in range(4)]
        texts.append(" ".join(chain))
    # Sets of 80 in 100 and 79 in 99 shingles.
    long = [f"d{i}" for i in range(103)]
    texts += [" ".join(long), " ".join(long[:83]), " ".join(long[:82])]
    docs = spark.createDataFrame([(7 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    check(docs)


def test_registers_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (10, 9), (300, 200), (3000, 600)):
        jaccard, got = common / (2 * n - common), []
        for _ in range(60):
            pool = rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
            a, b = sk.registers(pool[:n]), sk.registers(pool[n - common :])
            assert (sk.registers(pool) == np.maximum(a, b)).all()  # of a union
            got.append((a == b).mean())
        assert abs(np.mean(got) - jaccard) < 0.03


def test_likelihood_keeps_similar_pairs_and_drops_others():
    n = np.full(3, 500.0)
    at = {s: np.full(3, round(sk.REGISTERS * (1 - s) / 2)) for s in (0.2, 0.5, 0.75, 0.8, 0.95)}
    assert [sk.plausible(k, k, n, n).all() for k in at.values()] == [False, False, True, True, True]
    assert not sk.plausible(np.array([0]), np.array([0]), np.array([79.0]), np.array([100.0])).any()


def test_long_texts_are_taken_whole(monkeypatch):
    from logevidence.llm import common

    text = " ".join(f"w{i % 997} v{i % 101}" for i in range(5_000)).encode()
    whole = sk.shingle_set(text)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    assert (sk.shingle_set(text) == whole).all() and len(whole) == len(brute_set(text.decode()))


@pytest.mark.parametrize("a, b", [([], [1]), ([1, 2, 9], [2, 9, 10, 11]), ([5], [5])])
def test_common_elements(a, b):
    assert sk.common_elements(*(np.array(x, dtype=np.uint64) for x in (a, b))) == len(set(a) & set(b))


def test_register_test_of_the_join(spark):
    """Pairs pass in their first equal band, and only with enough equal registers."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, sk.REGISTERS, dtype=np.uint16)
    rows, wanted = [], []
    for k, changed in enumerate((0, 1, 30, sk.REGISTERS - sk.least_equal(), sk.REGISTERS - sk.least_equal() + 1, 100)):
        b = a.copy()
        b[rng.choice(sk.REGISTERS, changed, replace=False)] ^= 1 << int(rng.integers(0, 16))
        x, y = a.view(np.int64), b.view(np.int64)
        for band in range(sk.BANDS):
            if x[band] == y[band]:
                rows.append((100 * k + band, (band, x.tolist()), (y.tolist(),)))
                if changed <= sk.REGISTERS - sk.least_equal() and band == np.flatnonzero(x == y)[0]:
                    wanted.append(100 * k + band)
    frame = spark.createDataFrame(rows, "i int, a struct<band int, sketch array<long>>, b struct<sketch array<long>>")
    assert sorted(r.i for r in frame.where(sk._registers_allow("a", "b")).collect()) == wanted


def test_parities_tell_the_difference_from_below(spark):
    """Bits never exceed the elements that two sets differ in, and pairs with too many go before the full sets meet."""
    rng = np.random.default_rng(8)
    rows, wanted = [], []
    for k, own in enumerate((0, 5, 22, 23, 60, 200)):  # of 200 and 200 elements, 44 in all may differ
        pool = rng.choice(1 << 62, 200 + own, replace=False).astype(np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[own:])
        bits = int(np.bitwise_count((sk.parities(a) ^ sk.parities(b)).view(np.uint64)).sum())
        assert bits <= 2 * own and (bits > 0) == (own > 0)
        rows.append((k, *((len(s), sk.parities(s).tolist()) for s in (a, b))))
        if 180 * bits <= 20 * 400:
            wanted.append(k)
        assert (k in wanted) == (own < 60) or own == 23  # similar ones stay
    side = "struct<n long, parity array<long>>"
    frame = spark.createDataFrame(rows, f"i int, a {side}, b {side}")
    assert sorted(r.i for r in frame.where(sk._parities_allow("a", "b")).collect()) == wanted


def test_stars_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    from logevidence.llm import components as c

    rounds, kept = [], c.written
    monkeypatch.setattr(c, "written", lambda df, name: rounds.append(name) or kept(df, name))
    edges = spark.createDataFrame([(min(9, i), max(9, i)) for i in range(20) if i != 9] + [(30, 31), (40, 40)], "u long, v long")
    assert sorted(map(tuple, c.stars(edges).collect())) == [(i, 0) for i in range(1, 20)] + [(31, 30)]
    assert len(rounds) == 1
    assert c.stars(edges.where("u > 100")).count() == 0
