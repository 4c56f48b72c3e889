import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from logevidence.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=9), st.floats(0.1, 5))
def test_targets(sizes, share):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    total = share * sum(sizes)
    got = m.targets(sizes, weights, total)
    assert all(-1e-6 <= g <= 3 * s + 1e-6 for g, s in zip(got, sizes))
    assert sum(got) == pytest.approx(min(total, 3 * sum(sizes)), abs=1e-6)
    # Those that aren't stopped share by weight.
    free = [g / w for g, w, s in zip(got, weights, sizes) if s and g < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 5):
            assert sorted(m.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert m.permuted(np.arange(1000), 1000, 1).tolist() != m.permuted(np.arange(1000), 1000, 2).tolist()


def check(docs):
    rows = m.taken_digest(docs).collect()
    source = docs.select("doc_id", "text", "source").collect()
    sizes = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in source)
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    of = {}
    for r in source:
        of[r.source] = of.get(r.source, 0) + len(WORD.findall(r.text or ""))
    order = sorted(of, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, m.targets([of[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], sum(of.values()))))
    by_target = Counter()
    for r in rows:
        by_target[(r.source_size, r.target)] += r.taken
    for s in order:
        got = by_target[(of[s], wanted[s])]
        same = sum(1 for x in order if (of[x], wanted[x]) == (of[s], wanted[s]))
        assert abs(got / same - wanted[s]) <= m.BLOCK_WORDS + 0.005 * wanted[s]
    again = m.taken_digest(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_small_table(small):
    check(small)


def test_edge_cases(edge, clashing, empty):
    check(edge)
    check(clashing)
    assert m.taken_digest(empty).count() == 0
    assert m.mixed_documents(empty).count() == 0
    assert m.mixed_documents(clashing).columns == clashing.columns


def test_mixed_texts_are_runs_of_the_documents(small, edge):
    for docs in (small, edge):
        rows = m.mixed_documents(docs).collect()
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        assert all(any(r.text in t for t in texts[r.doc_id]) for r in rows)
        assert all(r.n_chars == len(r.text) and len(WORD.findall(r.text)) <= m.BLOCK_WORDS for r in rows)
        taken = Counter()
        for r in rows:
            taken[r.doc_id] += len(WORD.findall(r.text))
        wanted = Counter()
        for r in m.taken_digest(docs).collect():
            wanted[r.doc_id] += r.taken
        assert +taken == +wanted


def test_blocks_are_whole(small, edge, empty):
    assert m.mixed_blocks(empty).count() == 0
    for docs in (small, edge):
        streams, uses = {}, Counter()
        rows = m.mixed_blocks(docs).collect()
        for r in rows:
            words = WORD.findall(r.text)
            uses[r.source, r.text] += 1
            streams.setdefault(r.source, []).append(len(words))
        shorter = {s: {t for (of, t) in uses if of == s and len(WORD.findall(t)) < m.BLOCK_WORDS} for s in streams}
        assert all(max(n) <= m.BLOCK_WORDS for n in streams.values())
        assert all(len(t) <= 1 for t in shorter.values()), {s: [len(WORD.findall(x)) for x in t] for s, t in shorter.items()}
        for s in streams:
            slots = sorted(r.slot for r in rows if r.source == s)
            assert slots == list(range(len(slots)))
        taken = Counter()
        for r in m.taken_digest(docs).collect():
            taken[None] += r.taken
        assert sum(sum(n) for n in streams.values()) == taken[None]
        runs = Counter((r.doc_id, t) for r in m.mixed_documents(docs).collect() for t in [r.text])
        assert sum(len(r.doc_ids) for r in rows) == sum(runs.values())
        assert Counter(i for r in rows for i in r.doc_ids) == Counter({i: sum(n for (d, _), n in runs.items() if d == i) for i in {d for d, _ in runs}})


def test_shards_draw_every_source(spark):
    plan = spark.createDataFrame([("a", 0, 60_000, 150_000.0), ("b", 1, 90_000, 40_000.0), (None, 2, 10, 0.0)], "source string, source_no int, source_size long, target double")
    rows = m.slots(plan, block_words=10, shard_slots=500).collect()
    count = Counter(r.source_no for r in rows)
    assert count == {0: 15_000, 1: 4_000}
    uses = Counter((r.source_no, r.block) for r in rows)
    assert set(Counter(v for (s, _), v in uses.items() if s == 0)) == {2, 3} and max(v for (s, _), v in uses.items() if s == 1) == 1
    a_share = [sum(r.source_no == 0 for r in rows if r.shard == h) / 500 for h in range(5)]
    assert all(abs(a - 15 / 19) < 0.1 for a in a_share) and len(set(a_share)) > 1
