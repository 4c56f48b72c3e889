import random
import re

import pyspark.sql.functions as F
import xxhash

from logevidence.llm import simhash
from logevidence.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, max_bits=2):
    """rows (id, fingerprint) -> the smallest id reachable from each row."""
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= max_bits:
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(doc, ids.get(root(i), doc))
    return [ids.get(root(i)) for i in range(len(rows))]


def check(docs):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, brute_fingerprint(t)) for i, t in source]
    wanted = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows))]
    got = [tuple(r) for r in simhash.near_duplicate_digest(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_small_table_against_all_pairs(small):
    check(small)


def test_edge_cases(edge, clashing, empty):
    check(edge)
    check(clashing)
    assert simhash.near_duplicate_digest(empty).count() == 0


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for bits in (1, 1, 2, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            fps.add(y)
    fps |= {0, (1 << 64) - 1, 1 << 31, 1 << 63, 3 << 62}
    fps = sorted(fps)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for most in (0, 1, 2, 3):
        got = {frozenset((r.u, r.v)) for r in simhash.links(frame, most).collect()}
        wanted = {frozenset((signed[a], signed[b])) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= most}
        assert got == wanted


def test_one_of_each_group_stays(edge, clashing, small):
    for docs in (edge, clashing, small):
        source = docs.select("doc_id", "text").collect()
        groups = brute_components([(i, brute_fingerprint(r.text)) for i, r in enumerate(source)])
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len(set(groups))
        first = {}
        for r, g in zip(source, groups):
            first[g] = min(first.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(first.values())


def test_components_of_a_long_chain_and_a_star(spark):
    n = 150
    edges = [(i, i + 1) for i in range(0, n)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5, 7000), (7000, -5), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(300)) and got[7000] == -5
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_python_beside_the_fingerprint(small):
    plan = simhash.links(small.select(F.xxhash64("text").alias("fp")).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
