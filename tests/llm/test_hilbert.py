import tempfile
import zlib

import pytest

from logevidence.llm import hilbert as h


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 3), (2, 5), (1, 4)])
def test_curve_visits_every_cell_in_unit_steps(spark, dims, bits):
    names = [f"d{i}" for i in range(dims)]
    cells = [tuple(r[n] for n in names) for r in h.all_cells(spark.range(1), names, bits).orderBy("hilbert").collect()]
    assert len(set(cells)) == 2 ** (dims * bits)
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(cells, cells[1:]))


def check(docs, shards=24):
    rows = h.shard_digest(docs, shards).collect()
    source = docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    wanted = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == wanted
    slots = {}
    for r in rows:
        assert r.law == "rows" and 0 <= r.shard < shards and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    along = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)


def test_small_table(small):
    check(small)
    check(small, 7)


def test_edge_cases(edge, clashing, empty):
    check(edge)
    check(clashing)
    assert h.shard_digest(empty).count() == 0


def test_reruns_agree(small):
    assert sorted(map(str, h.shard_digest(small).collect())) == sorted(map(str, h.shard_digest(small).collect()))


def test_native(small):
    plan = h.shard_digest(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_files_are_runs_of_the_curve(spark, edge, clashing, small):
    for docs in (edge, clashing, small):
        path = tempfile.mkdtemp(prefix="logevidence-test-") + "/shards"
        h.write_shards(docs, path, shards=5)
        back = spark.read.parquet(path)
        assert back.columns == docs.columns
        assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


def test_runs_prune_in_several_dimensions(spark):
    """A shard spans a part of each dimension, not all of it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = h.shard_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    span = sum((max(r.doc_id for r in s) - min(r.doc_id for r in s)) / 1000 for s in shards.values()) / 24
    langs = sum(len({r.lang for r in s}) for s in shards.values()) / 24
    assert span < 0.95 and langs < 3.5
