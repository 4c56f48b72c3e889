"""Plan-shape regression tests: the scale properties the design relies on."""
import __spark_entry__ as E

from logevidence.operators.index import VectorIndex
from logevidence.operators.retrieval import build_where, search
from logevidence.plans import driver_tables as D

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_no_pair_joins_or_row_udfs_anywhere(spark):
    for name, fn in E.queries().items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert "BatchEvalPython" not in p, name  # no row-at-a-time Python UDFs


def test_topk_shapes(spark):
    assert "TakeOrderedAndProject" in plan(E.queries()["q_topk_cosine"](spark, SF))
    p = plan(E.queries()["q_batch_retrieve"](spark, SF))
    assert "WindowGroupLimit" in p and "MapInPandas" in p


def test_index_search_pushes_filters_and_prunes_text(spark, tmpdir_path):
    ix = VectorIndex(spark, tmpdir_path, "c")
    ix.upsert(D.vector_points(spark, SF))
    p = formatted(spark, search(ix.points(), D.first_vector(spark, SF), 5, "cosine", build_where("label_1", "error")))
    assert "EqualTo(source_file,label_1)" in p and "GreaterThan(sev_error,0)" in p
    scan_schema = p.split("ReadSchema: ", 1)[1].split("\n", 1)[0]
    assert "text:" not in scan_schema  # scoring never reads the chunk text
