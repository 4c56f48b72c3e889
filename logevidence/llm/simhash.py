"""SimHash near-dedup by anchor points of a covering code.

A fingerprint's halves are mapped to the words of a Hamming code, which cover
all bit strings at radius 1. Two fingerprints that differ in ``max_bits``
bits differ in at most ``max_bits // 2`` bits of one half; so if each is
replicated to every anchor within radius plus that threshold, the nearest
anchor of the one is among the anchors of the other. Per anchor, fingerprints
whose nearest anchor it is are compared with those replicated to it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import key_columns, word_batches, written
from logevidence.llm.components import components

HASH_SEED = 42
MAX_BITS = 2
SHINGLE_WORDS = 3

# The Hamming code on 31 of a half's 32 bits: bit i (from 1) has syndrome i.
CODE_BITS = 31
CODE_MASK = (1 << CODE_BITS) - 1
PARITY_MASKS = [sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> b & 1) for b in range(5)]

_hash = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, the hashes that have it set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 ones fit a byte
    blocks = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return blocks.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text, as an unsigned 64-bit integer."""
    if not raw:
        return 0
    counts, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for batch in word_batches(raw.lower()):  # bytes.lower changes A-Z only
        words = carry + batch
        n = len(words) - shingle_words + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle_words)), strict=True))
            counts += _bit_counts(np.fromiter(map(_hash, shingles), dtype="<u8", count=n))
            total += n
            carry = words[n:]
        else:
            carry = words
    if total == 0:
        return _hash(b" ".join(carry)) if carry else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of each text as a signed long with the same bits."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle_words) for x in texts.cast(pa.binary())), dtype="<u8", count=len(texts))
        return pa.array(out.view("<i8"))

    return fingerprints(text)


def _halves(fp: Column) -> Column:
    low = fp.bitwiseAND(F.lit(CODE_MASK))
    return F.array(
        F.struct(F.lit(0).alias("half"), low.alias("bits")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(CODE_MASK)).alias("bits")),
    )


def _flip(bits: Column, i: Column) -> Column:
    """``bits`` with its bit ``i`` (from 1) flipped; as it is for 0."""
    return bits.bitwiseXOR(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)))


def _with_syndrome(fps: DataFrame) -> DataFrame:
    half = fps.select("fp", F.inline(_halves(F.col("fp"))))
    syndrome = F.lit(0)
    for b, mask in enumerate(PARITY_MASKS):
        syndrome = syndrome + F.bit_count(F.col("bits").bitwiseAND(F.lit(mask))) % 2 * (1 << b)
    return half.withColumn("syndrome", syndrome)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps`` (fp long, distinct) -> every pair u < v within ``max_bits`` bits, once.

    ``max_bits`` is 3 at most: then one half has 1 differing bit or none. A
    fingerprint is replicated to 31 anchors on average.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover 0 to 3 differing bits")
    coded = _with_syndrome(fps)
    home = coded.select("half", _flip(F.col("bits"), F.col("syndrome")).alias("anchor"), F.col("fp").alias("u"))
    s = F.col("syndrome")
    # Code words at distance 2 flip two bits whose syndromes add up to s.
    two = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(CODE_BITS)), lambda i: (s != 0) & (i != s) & (i < i.bitwiseXOR(s))),
        lambda i: _flip(_flip(F.col("bits"), i), i.bitwiseXOR(s)),
    )
    replicas = coded.select("half", F.explode(F.concat(F.array(_flip(F.col("bits"), s)), two)).alias("anchor"), F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    # Replicas are many times the rows that they are made of, by which Spark would take them for small.
    return (
        home.alias("a")
        .join(replicas.hint("merge").alias("b"), (F.col("a.half") == F.col("b.half")) & (F.col("a.anchor") == F.col("b.anchor")) & near)
        .select("u", "v")
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, id_key, text_key, fp, root, component_id), a row per document.

    Texts without a word have fingerprint 0 and link like any other. Texts are
    lower-cased in A-Z; repeated shingles count. ``component_id`` is the
    smallest doc_id of the component, null if all its doc_ids are; ``root`` its
    smallest fingerprint. Copies share a fingerprint, so only distinct
    fingerprints are compared. An empty table gives an empty result.
    """
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    rows = written(
        docs.select("doc_id", id_key.alias("id_key"), text_key.alias("text_key"), fingerprint_column(F.col("text"), shingle_words).alias("fp")),
        "fingerprints",
    )
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    rooted = written(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root")
    return rows.join(named, "fp").select("doc_id", "id_key", "text_key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays, with all its columns: that of the
    smallest doc_id, then of the smallest text key; of equal rows one."""
    found = near_duplicates(docs, shingle_words, max_bits)
    # A null doc_id comes after all others.
    stays = (
        found.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "id_key", "text_key")).alias("first"))
        .select(F.col("first.id_key").alias("_id"), F.col("first.text_key").alias("_text"))
    )
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    id_key, text_key = key_columns(F.col("_row.doc_id"), F.col("_row.text"))
    keyed = docs.select(row.alias("_row")).select("_row", id_key.alias("_id"), text_key.alias("_text"))
    return keyed.join(stays, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """The columns (doc_id, fingerprint, component_id) of a report on all documents."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
