"""Token-id files in Simple-8b blocks.

Documents are range-partitioned by id, tokenised, and each task writes its
ids as a run of blocks in ascending id order. A block holds whole documents
and says where it and they begin, so any block can be decoded by itself.
Blocks are rows of Parquet files, whose commit protocol leaves no half-written
file behind when an executor is lost.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from logevidence.llm import simple8b
from logevidence.llm.common import key_columns
from logevidence.llm.pretokens import Splitter, gather
from logevidence.session import shared_dir

TOKENIZER_PATH = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BLOCK_IDS = 1 << 16
# Distinct stretches whose ids a worker process remembers at most (some 250 MB).
REMEMBERED = 1_000_000

STORE = "part int, block int, first_in_part long, n_ids long, width int, words binary, escapes binary, doc_ids array<long>, doc_lengths array<long>"


def read_tokenizer(path: str = TOKENIZER_PATH) -> bytes:
    """The tokenizer file's content; it goes to the tasks with the plan (some MB)."""
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _model(content: bytes):
    return Tokenizer.from_buffer(content).model.tokenize


def added_tokens(content: bytes) -> dict[str, int]:
    """Ids of the strings that the tokenizer cuts out of a text before all else."""
    tokens = json.loads(content).get("added_tokens", [])
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r}: single_word, lstrip and rstrip aren't built")
    return {t["content"]: t["id"] for t in tokens}


class TokenIds:
    """Ids of texts by the tokenizer's added tokens and merges, each distinct pre-token once while remembered."""

    def __init__(self, content: bytes):
        self.tokenize = _model(content)
        self.added = added_tokens(content)
        # The first match counts, of those at one place the longest.
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.splitter, self.known = Splitter(public_tokenizers.PATTERN), 0
        # Ids of pre-tokens, then of stretches, each one after another, and where they end.
        self.piece_ids, self.piece_ends = array("I"), array("q", [0])
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the stretches that are new since the last time."""
        alphabet, tokenize, ids, ends = self.alphabet, self.tokenize, self.piece_ids, self.piece_ends
        blank = alphabet[ord(" ")]
        for piece in islice(self.splitter.pieces, len(ends) - 1, None):
            if piece.isascii() and piece.isprintable():  # these stand for themselves, but for the space
                shown = piece.replace(" ", blank)
            else:
                shown = "".join(map(alphabet.__getitem__, piece.encode()))
            ids.extend([t.id for t in tokenize(shown)])
            ends.append(len(ids))
        pieces, begins = self.splitter.offsets(self.known)
        of_piece = np.array(ends, dtype=np.int64)
        self.flat = np.concatenate([self.flat, gather(pieces, np.array(ids, dtype=np.uint32), of_piece)])
        upto = np.concatenate([[0], np.cumsum(np.diff(of_piece)[pieces])])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto[begins[1:]]])
        self.known = len(self.splitter)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's end."""
        if not any(a in t for t in texts for a in self.added):
            return self._merged(texts)
        # Text, token, text, ..., text; the texts between are each split by themselves.
        cut = [self.find_added.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        flat, ends = self._merged([between for c in cut for between in c[::2]])
        followed = np.array([k < len(c) // 2 for c in cut for k in range(len(c) // 2 + 1)])
        flat = np.insert(flat, ends[followed], [self.added[x] for c in cut for x in c[1::2]])
        return flat, (ends + np.cumsum(followed))[~followed]

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without added tokens."""
        if len(self.splitter) > REMEMBERED:
            self.forget()
        codes = [self.splitter.split(t) for t in texts]
        self._learn()
        joined = np.fromiter(chain.from_iterable(codes), dtype=np.int64, count=sum(map(len, codes)))
        upto = np.concatenate([[0], np.cumsum(np.diff(self.ends)[joined])])
        return gather(joined, self.flat, self.ends), upto[np.cumsum(list(map(len, codes)), dtype=np.int64)]


@cache
def _token_ids(content: bytes) -> TokenIds:
    """One a worker process: what it has learned serves its next tasks too."""
    return TokenIds(content)


def _block(part: int, number: int, first: int, keys: list[int | None], ends: list[int], joined: np.ndarray) -> pa.RecordBatch:
    width, words, escapes = simple8b.encode(joined)
    row = {"part": part, "block": number, "first_in_part": first, "n_ids": len(joined), "width": width, "words": words, "escapes": escapes, "doc_ids": keys, "doc_lengths": np.diff(ends, prepend=0).tolist()}
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_in_part", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("words", pa.binary()), ("escapes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def write_token_files(docs: DataFrame, path: str, content: bytes | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text, ...), END_ID after each, under ``path``.

    Ascending doc_id, nulls first; rows of one doc_id by a hash of their text.
    Null and empty texts are just the end id. Whole texts of any length; added
    tokens inside them get their ids. An empty table writes no block.
    """
    tokenizer = content if content is not None else read_tokenizer()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        token_ids = _token_ids(tokenizer)
        keys: list[int | None] = []
        ends: list[int] = []
        held = np.zeros(0, dtype=np.uint32)
        for batch in batches:
            flat, upto = token_ids.encode([t or "" for t in batch.column("text").to_pylist()])
            upto_end = upto + np.arange(1, len(upto) + 1)  # with the end ids before and its own
            ends += (len(held) + upto_end).tolist()
            keys += batch.column("doc_id").to_pylist()
            held = np.concatenate([held, np.insert(flat, upto, END_ID)])
            while len(held) >= BLOCK_IDS:
                n = bisect_left(ends, BLOCK_IDS) + 1  # documents up to the one that fills the block
                yield _block(part, number, first, keys[:n], ends[:n], held[: ends[n - 1]])
                number, first, done = number + 1, first + ends[n - 1], ends[n - 1]
                keys, ends, held = keys[n:], [e - done for e in ends[n:]], held[done:]
        if keys:
            yield _block(part, number, first, keys, ends, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, by_text = key_columns(F.col("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), by_text).sortWithinPartitions(F.col("doc_id"), by_text)
    ordered.mapInArrow(blocks, STORE).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["width"], row["words"], row["escapes"]).astype("<u4")
            ends = np.cumsum(row["doc_lengths"])
            starts = ends - row["doc_lengths"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["part"]] * len(ends), pa.int32()),
                    pa.array(row["first_in_part"] + starts, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ],
                names=["doc_id", "part", "start", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """-> doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit), a row per document."""
    store = spark.read.schema(STORE).parquet(path)
    # One row per file written: what stands in the files before.
    before = (
        store.groupBy("part").agg(F.sum("n_ids").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "before")
    )
    rows = store.mapInArrow(_documents, "doc_id long, part int, start long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "ids")


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Write all documents' files to the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_token_files(docs, path)
    rows = read_token_files(docs.sparkSession, path)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
