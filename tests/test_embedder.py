import pytest
from pyspark.sql import functions as F

from logevidence.operators.embedding import BatchEncoder, HashEncoder, embed_chunks, text_buckets
from logevidence.functions.vectors import token_buckets


def make_factories():
    # Defined inside a function so that the workers receive them by value.
    def fake_factory():
        def encode(texts):
            return [[float(len(t)), float(len(t.split())), float(len(t.splitlines()))] for t in texts]
        return encode

    def bad_factory():
        def encode(texts):
            return [[1.0]] * (len(texts) + 1)
        return encode

    return fake_factory, bad_factory


def chunks(spark, texts):
    rows = [(f"c-{i}", "f.log", 1, 2, None, None, {"error": 1}, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "chunk_id string, source_file string, line_start long, line_end long, ts_start string, "
              "ts_end string, severities map<string,int>, text string")


def test_fake_encoder_inherits_metadata(spark):
    fake_factory, _ = make_factories()
    recs = embed_chunks(chunks(spark, ["a b\nc", "", None]), BatchEncoder(fake_factory, "fake", 2)).orderBy("chunk_id").collect()
    assert [list(r["embedding"]) for r in recs] == [[5.0, 3.0, 2.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    assert all(r["embedding_dim"] == 3 and r["embedding_model"] == "fake" for r in recs)
    assert recs[0]["severities"] == {"error": 1} and recs[0]["source_file"] == "f.log"


def test_empty_input_and_count_mismatch(spark):
    fake_factory, bad_factory = make_factories()
    assert embed_chunks(chunks(spark, []), BatchEncoder(fake_factory, "fake")).count() == 0
    with pytest.raises(Exception, match="vectors for"):
        embed_chunks(chunks(spark, ["x"]), BatchEncoder(bad_factory, "bad")).collect()


def test_hash_encoder_python_equals_jvm_buckets(spark):
    texts = ["[2024-01-01T00:00:07+00:00] haproxy error GET /error/0 503 - be_api/<NOSRV>", "", "ÉCOLE a-b_c 42"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    jvm = [r[0] for r in df.select(token_buckets(F.col("text"), 384)).collect()]
    assert jvm == [text_buckets(t, 384) for t in texts]
    vecs = [r[0] for r in df.select(HashEncoder(384).vector("text")).collect()]
    assert len(vecs[0]) == 384 and abs(sum(x * x for x in vecs[0]) - 1.0) < 1e-5
    assert all(x == 0.0 for x in vecs[1])


def test_local_query_vector_equals_spark_vector(spark):
    enc = HashEncoder(64)
    text = "503 error be api <nosrv> 503"
    df = spark.createDataFrame([(text,)], "text string")
    assert [float(x) for x in df.select(enc.vector("text")).first()[0]] == enc.encode_local([text])[0]
