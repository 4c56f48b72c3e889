import pytest
import pyspark.sql.functions as F

from logevidence.llm import queries


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_knn_quality"])
def test_columns_named_like_labels_change_nothing(spark, tmp_path, small, labels, name):
    more = small.withColumn("toxic", F.lit("x")).withColumn("quality", F.lit(7)).withColumn("label", F.lit(1))
    for folder, docs in (("plain", small), ("more", more)):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    a, b = (sorted(map(str, queries.REGISTRY[name](spark, f"{tmp_path}/{folder}").collect())) for folder in ("plain", "more"))
    assert len(a) == small.count() and a == b
