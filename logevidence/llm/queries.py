"""Each operator applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logevidence.llm import alignment, bpe, hilbert, imatch, knn_quality, langid, mixing, quality_rules, setsketch, simhash, token_store, toxicity, whitening
from logevidence.llm.common import bounded_batches, held_out, read_documents, read_labels


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows with crc32(doc_id) mod 3 other than 1."""
    docs, out = read_documents(spark, sf_dir), held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.select("doc_id", "text").join(read_labels(spark, sf_dir).select("doc_id", "toxic"), "doc_id").where(~out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all documents' sources takes of each document."""
    return mixing.taken_digest(read_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    return token_store.token_file_digest(read_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    return bpe.round_trip_digest(read_documents(spark, sf_dir))


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows with crc32(doc_id) mod 5 other than 0."""
    docs, out = read_documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = knn_quality.fit(docs, docs.select("doc_id", "text").join(read_labels(spark, sf_dir).select("doc_id", "quality"), "doc_id").where(~out))
    return knn_quality.score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return imatch.fingerprint_digest(read_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.quality_digest(read_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 2 or fewer differing bits."""
    return simhash.near_duplicate_digest(read_documents(spark, sf_dir))


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along a Hilbert curve."""
    return hilbert.shard_digest(read_documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows with crc32(doc_id) mod 4 other than 2."""
    docs, out = read_documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, docs.where(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, a row per usable vector and component."""
    return whitening.whitening_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document; links at 80 % common shingles."""
    return setsketch.near_duplicate_digest(read_documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens by two tokenizers."""
    return alignment.alignment_digest(read_documents(spark, sf_dir))


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


OPERATORS = (
    op1_toxicity,
    op2_mixing,
    op3_token_files,
    op4_bpe,
    op5_knn_quality,
    op6_imatch,
    op7_quality_rules,
    op8_simhash,
    op9_hilbert,
    op10_langid,
    op11_whitening,
    op12_setsketch,
    op13_alignment,
)
REGISTRY = {f.__name__: _bounded(f) for f in OPERATORS}

# DuckDB SQL where SQL can express the whole result.
SQL: dict[str, str] = {}
