import numpy as np
import pyspark.sql.functions as F
import pytest

from logevidence.operators.cells import Cells, fit_cells, search_cells, write_cells
from logevidence.operators.retrieval import search
from logevidence.plans import driver_tables as D

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_recall_and_pruning(spark, tmpdir_path, metric):
    points = D.vector_points(spark, SF).cache()
    cells = fit_cells(points, 32, metric=metric)
    write_cells(points, cells, f"{tmpdir_path}/cells")
    table = spark.read.parquet(f"{tmpdir_path}/cells")
    assert table.count() == points.count() and cells.probes < 32
    queries = [r.embedding for r in points.where("cast(id as long) % 50 = 0").select("embedding").collect()]
    found = 0
    for q in queries[:20]:
        exact = {r.id for r in search(points, q, top_k=10, metric=metric).collect()}
        found += len(exact & {r.id for r in search_cells(table, cells, q, top_k=10).collect()})
    assert found >= 0.9 * 10 * 20
    one = search_cells(table, cells, queries[0], top_k=10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    everything = search_cells(table, cells, queries[0], top_k=10, probes=32)
    assert [r.id for r in everything.collect()] == [r.id for r in search(points, queries[0], top_k=10, metric=metric).collect()]


def test_odd_points(spark, tmpdir_path):
    kind = "id string, embedding array<float>"
    empty = spark.createDataFrame([], kind)
    assert fit_cells(empty).probes == fit_cells(spark.createDataFrame([("a", None), ("b", [])], kind)).probes == 1
    points = spark.createDataFrame([("a", None), ("b", []), ("c", [1.0, 0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", [1.0]), ("f", [0.0, 0.0])], kind).where(F.coalesce(F.size("embedding"), F.lit(0)) != 1)
    cells = fit_cells(points, 8)
    write_cells(points, cells, f"{tmpdir_path}/odd")
    table = spark.read.parquet(f"{tmpdir_path}/odd")
    assert table.count() == points.count() and table.where("cell = -1").count() == 2
    assert [r.id for r in search_cells(table, cells, [1.0, 0.1], top_k=2, probes=8).collect()] == ["c", "c"]
    assert search_cells(table, Cells("cosine", np.zeros((1, 1)), 1, 1.0), [1.0, 0.1]).count() <= 5
