"""A training corpus from raw documents: filter, deduplicate, mix, tokenise.

Each stage is a function of (spark, docs, sf_dir) over all documents that the
stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logevidence.llm import bpe, mixing, quality_rules, simhash, toxicity
from logevidence.llm.common import bounded_batches, held_out, read_documents, read_labels, written
from logevidence.session import apply_job_conf


def _ready(spark: SparkSession) -> None:
    apply_job_conf(spark)
    bounded_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    _ready(spark)
    return quality_rules.keep_good(docs)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold, learned from labelled rows that aren't held out."""
    _ready(spark)
    labelled = docs.select("doc_id", "text").join(read_labels(spark, sf_dir).select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit(labelled.where(~held_out(F.col("doc_id"), 3, 1)))
    return toxicity.drop_toxic(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 3-word shingles, 2 differing bits at most."""
    _ready(spark)
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row per run of words that a block takes of a document."""
    _ready(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with hashes of them and of what they decode to."""
    _ready(spark)
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("toxicity", nontoxic), ("simhash", distinct), ("mixing", mixed), ("bpe", tokens)]

# Expectation maximisation, trained scores and merges have no SQL; the tests
# hold run() against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
