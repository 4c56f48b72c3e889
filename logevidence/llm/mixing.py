"""Mixing sources to target weights in fixed-length blocks of words.

Each source's documents form one stream of words, cut into blocks. Output
shards draw multinomial counts of slots per source; a source's slots are
numbered through all shards, go round its blocks once per epoch through a
pseudorandom permutation of the block indexes, and get their blocks by a join
on the index. Everything follows from the rows and the seed: reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logevidence.llm.common import SPACE_BYTES, key_columns, word_batches, written

BLOCK_WORDS = 64
SHARD_SLOTS = 8_192
TASK_SLOTS = 1_000_000
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 20_24


def word_count(text: Column) -> Column:
    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, word_batches(x.as_buffer().to_pybytes()))) if x.is_valid else 0 for x in texts.cast(pa.binary())], pa.int64())

    return counted(text)


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_REPEATS) -> list[float]:
    """``total`` shared by weight; none above ``most`` times its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size); one row per source.

    Sources in code-point order, null last, take the weights in turn. The
    table of sources is the configuration of a mix, so it comes to the driver.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    found = targets([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share * sum(r.n for r in rows))
    return sized.sparkSession.createDataFrame(
        [(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(rows, found, strict=True))], "source string, source_no int, source_size long, target double"
    )


def stream_places(sized: DataFrame) -> DataFrame:
    """Add ``first``: where the row's words begin in its source's stream.

    Each source's rows are dealt to about as many buckets as a bucket has rows
    (the root of all rows), so that a hot source is many groups; sums run
    within buckets, and over a source's buckets. The order is by bucket, a
    hash of the id and text: a fixed shuffle of the source.
    """
    n = sized.count()
    buckets = max(1, math.isqrt(n))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("id_key", "text_key"), F.lit(buckets)))
    within = Window.partitionBy("source_no", "bucket").orderBy("id_key", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(before, ["source_no", "bucket"]).withColumn("first", F.col("before") + F.col("at")).drop("bucket", "before", "at")


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr(key).encode()))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network, walked until it is back in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _rng("round", key).integers(0, 2**63, size=4, dtype=np.uint64)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) & mask
        return left << np.uint64(half) | right

    out = step(index.astype(np.uint64))
    while (out >= n).any():
        out = np.where(out >= n, step(out), out)
    return out.astype(np.int64)


def slots(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Slots of a mix: (shard, slot, source_no, block).

    ``plan`` (source_no, source_size, target). Every shard draws its counts
    per source; the last, balancing shard then brings each source to exactly
    the slots of its target, and slots drawn beyond those fall away.
    """
    spark = plan.sparkSession
    rows = sorted(plan.where("target > 0").collect(), key=lambda r: r.source_no)
    quota = [_quota(r.source_size, r.target, block_words) for r in rows]
    total = sum(quota)
    if not total:
        return spark.createDataFrame([], "shard int, slot long, source_no int, block long")
    shares = [q / total for q in quota]
    shards = -(-total // shard_slots)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            counts = np.array([_rng(seed, int(h)).multinomial(shard_slots, shares) for h in ids]).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(shares)), pa.int64()), pa.array(np.tile(np.arange(len(shares)), len(ids)), pa.int32()), pa.array(counts.ravel(), pa.int64())],
                names=["shard", "place", "n"],
            )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, place, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "place", "first", "n")), strict=True):
                r, blocks = rows[place], -(-rows[place].source_size // block_words)
                for a in range(0, n, 1 << 16):
                    number = first + np.arange(a, min(n, a + (1 << 16)))
                    epoch, at = number // blocks, number % blocks
                    index = np.empty_like(number)
                    for e in np.unique(epoch).tolist():
                        index[epoch == e] = permuted(at[epoch == e], blocks, xxhash.xxh32_intdigest(f"{seed} {r.source_no} {e}"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(number), shard), pa.int32()), pa.array(number, pa.int64()), pa.array(np.full(len(number), r.source_no), pa.int32()), pa.array(index, pa.int64())],
                        names=["shard", "slot", "source_no", "block"],
                    )

    most = F.get(F.lit(quota), F.col("place"))
    counts = spark.range(shards, numPartitions=max(1, shards // 256)).mapInArrow(drawn, "shard long, place int, n long")
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("n", F.least("n", most - F.col("first")))
    totals = spark.createDataFrame(list(enumerate(quota)), "place int, quota long")
    balance = (
        totals.join(counts.groupBy("place").agg(F.max(F.col("first") + F.greatest("n", F.lit(0))).alias("drawn")), "place")
        .select(F.lit(shards).cast("long").alias("shard"), "place", F.least("drawn", "quota").alias("first"), (F.col("quota") - F.least("drawn", "quota")).alias("n"))
    )
    runs = counts.select("shard", "place", "first", "n").union(balance).where("n > 0")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_SLOTS)
    found = runs.repartition(tasks, "shard", "place").mapInArrow(mapped, "shard int, slot long, source_no int, block long")
    return found


def _quota(size: int, target: float, block_words: int) -> int:
    """Slots whose words come nearest the target: whole epochs, and the part of one."""
    blocks = -(-size // block_words)
    epochs, rest = divmod(target, size)
    return int(epochs) * blocks + min(blocks, round(rest / min(size, block_words)))


def spans(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Cut rows (source_no, first, size, ...) at block ends: adds block, from_word, past_word (in the document)."""
    last = F.col("first") + F.col("size") - 1
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words), F.floor(last / block_words))))
    start = F.col("block") * block_words - F.col("first")
    return cut.withColumn("from_word", F.greatest(start, F.lit(0).cast("long"))).withColumn("past_word", F.least(start + block_words, F.col("size")))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` (doc_id, text, source, ...) -> documents, plan, mixed spans.

    documents: doc_id, id_key, text_key, source_no, size, first, a row per row;
    a null text has no words. plan: see source_targets(). mixed spans: shard,
    slot, source_no, block and the document's columns with from_word,
    past_word: what each slot takes of which document. Documents without words
    are in no span.
    """
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), id_key.alias("id_key"), text_key.alias("text_key"), F.col("source").cast("string").alias("source")]
    sized = written(docs.select(*columns, word_count(F.col("text")).alias("size")), "sizes")
    plan = source_targets(sized)
    # One row per source.
    named = sized.join(F.broadcast(plan.select(F.col("source").alias("_s"), "source_no")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = written(stream_places(named), "stream")
    # Both sides are many times the rows that they are made of, by which Spark would take them for small.
    taken = slots(plan).join(spans(placed).hint("merge"), ["source_no", "block"])
    return placed, plan, taken


def taken_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    placed, plan, taken = mix(docs)
    # A document with words is where its words begin in its source's stream.
    words = taken.groupBy("source_no", "first").agg(F.sum(F.col("past_word") - F.col("from_word")).alias("taken"))
    counted = placed.where("size > 0").join(words, ["source_no", "first"], "left").select("source_no", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    rows = counted.union(placed.where("size = 0").select("source_no", "doc_id", "size", F.lit(0).cast("long")))
    return rows.join(F.broadcast(plan), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def _word_ends(raw: bytes) -> np.ndarray:
    """Begin and end of every word, in bytes."""
    marks = np.frombuffer(raw, dtype=np.uint8)
    space = np.isin(marks, np.frombuffer(SPACE_BYTES, dtype=np.uint8))
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.stack([np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)], axis=1)


def _mixed_runs(docs: DataFrame) -> DataFrame:
    """-> (_row, _run): a row per run of words that a slot takes of a document.

    ``_row`` has the document's columns, ``_run`` has shard, source_no, slot,
    place (words of the block before the run) and text.
    """
    _, plan, taken = mix(docs)
    # One row per source.
    taken = taken.join(F.broadcast(plan.select("source_no", "source")), "source_no")

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, wanted in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
            ends = _word_ends(text)
            out.append([text[ends[s["from_word"], 0] : ends[s["past_word"] - 1, 1]].decode() for s in wanted])
        return pa.array(out, pa.list_(pa.string()))

    # Rows of one id, text and source have one text, so one of them serves the spans of all.
    keys = ["_id", "_key", "_source"]
    place = (F.col("first") + F.col("from_word") - F.col("block") * BLOCK_WORDS).alias("place")
    span = F.struct("shard", "slot", "source_no", place, "from_word", "past_word")
    # A null source has a key of its own.
    of_source = lambda c: F.concat(F.lit("="), c.cast("string"))
    known = F.coalesce(of_source(F.col("source")), F.lit("")).alias("_source")
    wanted = taken.groupBy(F.col("id_key").alias("_id"), F.col("text_key").alias("_key"), known).agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    id_key, text_key = key_columns(F.col("_row.doc_id"), F.col("_row.text"))
    named = F.coalesce(of_source(F.col("_row.source")), F.lit("")).alias("_source")
    once = docs.select(row.alias("_row")).select("_row", id_key.alias("_id"), text_key.alias("_key"), named).dropDuplicates(keys)
    texts = once.join(wanted, keys).select("_row", "_spans", cut(F.col("_row.text"), F.col("_spans")).alias("_texts"))
    run = texts.select("_row", F.explode(F.arrays_zip("_spans", "_texts")).alias("_run"))
    return run.select("_row", F.struct(*(f"_run._spans.{c}" for c in ("shard", "source_no", "slot", "place")), F.col("_run._texts").alias("text")).alias("_run"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per run of words of each slot, with the
    document's other columns, the run's text, and its length in code points as
    n_chars where there is such a column.

    Null, empty and wordless texts are in no row. Repeated rows are taken each
    by their own share. An empty table gives an empty result.
    """
    shown = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_run.text")}
    if "n_chars" in shown:
        shown["n_chars"] = F.char_length("_run.text").cast(docs.schema["n_chars"].dataType)
    return _mixed_runs(docs).select(*(v.alias(c) for c, v in shown.items()))


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix as blocks: (shard, source, slot, doc_ids, text), a row per slot.

    A block has BLOCK_WORDS words, the last one of a source's stream may have
    fewer. ``doc_ids`` and ``text`` follow the stream's order; words of
    different documents are joined by a space. A null source is a source; slots
    are numbered from 0 in each source. Null, empty and wordless texts are in
    no block, an empty table gives none; columns beside doc_id, text and source
    don't matter.
    """
    run = F.struct("_run.place", F.col("_row.doc_id").cast("long").alias("doc_id"), "_run.text")
    runs = _mixed_runs(docs).select("_run.shard", "_run.source_no", "_run.slot", F.col("_row.source").cast("string").alias("source"), run.alias("run"))
    # A slot has no more runs than words.
    blocks = runs.groupBy("shard", "source_no", "source", "slot").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return blocks.select("shard", "source", "slot", F.col("runs.doc_id").alias("doc_ids"), F.array_join("runs.text", " ").alias("text"))
