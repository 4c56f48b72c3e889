"""Byte-level BPE over the distinct words of a whole table.

Texts become blocks of numbered pre-tokens with their positions. Each block's
distinct pre-tokens are dealt by hash to buckets, so equal ones of all blocks
meet; a bucket encodes each distinct one once, the ids go back to the blocks
that asked, and the blocks reassemble their texts by position. Decoding joins
the token-byte table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logevidence.llm.common import written_buckets
from logevidence.llm.pretokens import Splitter, gather

RANKS_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# A block ends with the text that brings it to so many characters, or distinct stretches.
BLOCK_CHARS = 6_000_000
BLOCK_STRETCHES = 150_000

# Pre-tokens (each block's distinct ones) that a bucket gets at most, about.
BUCKET_PIECES = 2_000_000

BLOCKS = "block long, keys array<long>, lengths array<long>, codes binary, n_pieces long, pieces array<string>"


def read_ranks(path: str = RANKS_PATH) -> bytes:
    """The rank file's content; it goes to the tasks with the plan (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


@cache
def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


@cache
def _encoding(content: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(content), special_tokens={})


@cache
def token_bytes(content: bytes) -> pa.Array:
    """The token-byte table: the bytes of each id, by id."""
    ranks = _ranks(content)
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def pack(codes: np.ndarray) -> bytes:
    """Codes with the frequent ones low: a byte each, and 4 bytes for those from 255 on."""
    low = np.minimum(codes, 255).astype(np.uint8)
    high = codes[codes >= 255].astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(low.tobytes() + high.tobytes())


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=5 * n + 64), dtype=np.uint8)
    codes = raw[:n].astype(np.uint32)
    codes[codes == 255] = np.ascontiguousarray(raw[n:].reshape(4, -1).T).view("<u4").ravel()
    return codes


def pack_lists(lengths: np.ndarray, joined: bytes) -> bytes:
    """Lists of bytes, one after another, as one compressed value."""
    raw = np.array([len(lengths)], dtype="<u4").tobytes() + lengths.astype("<u4").tobytes() + joined
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_lists(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    return np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64), raw[4 * n + 4 :]


def _cut(lengths: np.ndarray, joined: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _block(number: int, keys: list[int | None], texts: list[np.ndarray], splitter: Splitter) -> pa.RecordBatch:
    flat, begins = splitter.offsets()
    joined = np.concatenate(texts)
    stops = np.concatenate([[0], np.cumsum((begins[1:] - begins[:-1])[joined])])
    ends = stops[np.cumsum([len(t) for t in texts])]
    codes = gather(joined, flat, begins)
    order = np.argsort(-np.bincount(codes, minlength=len(splitter.pieces)), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    names = list(splitter.pieces)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([keys], pa.list_(pa.int64())),
            pa.array([np.diff(ends, prepend=0)], pa.list_(pa.int64())),
            pa.array([pack(place[codes])], pa.binary()),
            pa.array([len(names)], pa.int64()),
            pa.array([[names[i] for i in order]], pa.list_(pa.string())),
        ],
        names=["block", "keys", "lengths", "codes", "n_pieces", "pieces"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32

    def opened() -> tuple[list, list, Splitter]:
        return [], [], Splitter(public_tokenizers.PATTERN)

    (keys, texts, splitter), chars = opened(), 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            keys.append(key)
            texts.append(np.array(splitter.split(text or ""), dtype=np.int32))
            chars += len(text or "")
            if chars >= BLOCK_CHARS or len(splitter) >= BLOCK_STRETCHES:
                yield _block(number, keys, texts, splitter)
                (keys, texts, splitter), chars, number = opened(), 0, number + 1
    if keys:
        yield _block(number, keys, texts, splitter)


def encode(docs: DataFrame, key: str = "doc_id", ranks: bytes | None = None) -> DataFrame:
    """``docs`` (key long, text, ...) -> (key, ids array<int>), a row per row.

    Null and empty texts have no ids. Rows of one key, equal rows among them,
    are encoded each. Whole texts of any length; special tokens' strings are
    ordinary text.
    """
    content = ranks if ranks is not None else read_ranks()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pieces in zip(batch.column("block").to_pylist(), batch.column("pieces"), strict=True):
                raw = [x.encode() for x in pieces.as_py()]
                bucket = np.fromiter(map(zlib.crc32, raw), dtype=np.int64, count=len(raw)) % buckets
                order = np.argsort(bucket, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(at):
                        mine = [raw[i] for i in at.tolist()]
                        words = pack_lists(np.fromiter(map(len, mine), dtype=np.int64, count=len(mine)), b"".join(mine))
                        gaps = pack_lists(np.diff(at, prepend=0), b"")  # a bucket's places, ascending
                        yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[at[0]]), "block": block, "at": gaps, "words": words}], schema=dealt_schema)

    dealt_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("words", pa.binary())])

    def each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, known = _encoding(content).encode_ordinary, {}
        for batch in batches:
            out = []
            for packed in batch.column("words").to_pylist():
                words = _cut(*unpack_lists(packed))
                for w in set(words).difference(known):
                    known[w] = np.array(encoded(w.decode()), dtype="<u4").tobytes()
                ids = [known[w] for w in words]
                flat = np.frombuffer(b"".join(ids), dtype=np.uint8).reshape(-1, 4).T  # the high bytes are mostly 0
                out.append(pack_lists(np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids)), flat.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.array(out, pa.binary())], names=["block", "at", "ids"])

    def reassembled(block: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        places, lengths, flats = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for at, packed in zip(found.column("at").to_pylist(), found.column("ids").to_pylist(), strict=True):
            places.append(np.cumsum(unpack_lists(at)[0]))
            n, planes = unpack_lists(packed)
            lengths.append(n)
            flats.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel())
        order, n = np.argsort(np.concatenate(places)), np.concatenate(lengths)
        flat = gather(order, np.concatenate(flats), np.concatenate([[0], np.cumsum(n)]))
        begins = np.concatenate([[0], np.cumsum(n[order])])
        for row in block.to_pylist():
            pieces_in = np.array(row["lengths"], dtype=np.int64)
            codes = unpack(row["codes"], int(pieces_in.sum()))
            counts = np.concatenate([[0], np.cumsum((begins[1:] - begins[:-1])[codes])])
            offsets = pa.array(np.concatenate([[0], counts[np.cumsum(pieces_in)]]).astype(np.int64))
            ids = pa.array(gather(codes, flat, begins), pa.int32())
            out.append(pa.table([pa.array(row["keys"], pa.int64()), pa.LargeListArray.from_arrays(offsets, ids).cast(pa.list_(pa.int32()))], names=["key", "ids"]))
        return pa.concat_tables(out)

    blocks = written_buckets(docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(_blocks, BLOCKS), "blocks", "block")
    total = blocks.agg(F.coalesce(F.sum("n_pieces"), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_PIECES))
    words = blocks.select("block", "pieces").mapInArrow(dealt, "bucket int, block long, at binary, words binary")
    # A partition is a bucket.
    found = words.repartitionById(buckets, F.col("bucket")).mapInArrow(each_once, "block long, at binary, ids binary")
    joined = blocks.select("block", "keys", "lengths", "codes").groupBy("block").cogroup(found.groupBy("block"))
    return joined.applyInArrow(reassembled, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """Add ``decoded`` (binary) to rows with an array of token ids; null ids stay null.

    The token-byte table has a row per id of the vocabulary (50,256), is sent
    to every task and joined by id, a whole batch at once.
    """
    content = ranks if ranks is not None else read_ranks()

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        joined = token_bytes(content).take(column.flatten())
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(joined) + 1) if len(joined) else np.zeros(1, dtype=np.int64)
        per_row = np.diff(column.offsets.to_numpy())
        if column.null_count:
            per_row = np.where(column.is_valid().to_numpy(zero_copy_only=False), per_row, 0)
        offsets = ends[np.concatenate([[0], np.cumsum(per_row)])].tolist()
        view = memoryview(data if data is not None else b"")
        return pa.array([bytes(view[a:b]) if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)], pa.binary())

    return encoded.withColumn("decoded", decoded(F.col(ids)))


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    return decode(encode(docs)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return round_trip(docs).drop("ids")
