"""Alignment of two tokenizers over the same bytes.

A byte-level tokenizer (tokenizers library) gives character offsets, a piece
tokenizer (sentencepiece) gives spans. They are coarse cuts: characters of
several bytes, and pieces that stand for single bytes, are cut by the bytes
that the tokens decode to. Two token sequences over one text cut it into
segments; each segment is a link of the two tokens that it lies in.

Texts are cut into stretches where both tokenizers start a token; stretches
repeat, and each distinct one is encoded and aligned once.

Links are counted over the corpus by id pair. A block of documents sends each
of its distinct pairs once and gets each one's count back.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from logevidence.llm.common import written
from logevidence.llm.pretokens import CUT, ODD_SPACES, gather
from logevidence.llm.token_store import byte_alphabet

BYTE_LEVEL_PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES_PATH = public_tokenizers.path("piece_bpe_32k.model")
# Fixed value: what pieces have for a space.
SPACE_MARK = "\u2581"
# Distinct stretches that a worker process remembers at most before a block, and bytes of them and their groups;
# beyond either, half as much is kept.
REMEMBERED = 200_000
REMEMBERED_BYTES = 24 << 20
# Stretches that go through the tokenizers at once: what these return takes many times the bytes.
LEARNED = 8_192
# Bytes of text whose tokens are held at once, and of a block; a longer text stands alone.
CHUNK_BYTES = 1 << 19
BLOCK_BYTES = 2 << 20
# Blocks of a file: Spark's reader holds a file's rows together.
FILE_BLOCKS = 16

BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hashes array<string>, "
    "pairs array<long>, totals array<long>, ends array<long>, sizes array<long>, packed binary"
)


def read_file(path: str) -> bytes:
    """A tokenizer file's content; it goes to the tasks with the plan (some MB)."""
    with open(path, "rb") as f:
        return f.read()


class ByteLevelTokens:
    """Ids, byte lengths and bytes of texts by the byte-level tokenizer."""

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_alphabet().items()}
        spelled = {i: s for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in s)}
        self.decoded = _table([bytes(map(byte_of.__getitem__, spelled.get(i, ""))) for i in range(self.tokenizer.get_vocab_size())])

    def encode(self, texts: list[str]) -> Tokens:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids, counts = _flat([e.ids for e in found])
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), dtype=np.int64, count=2 * len(ids))
        # Characters of several bytes may be cut inside: there the decoded bytes say where.
        whole = np.repeat(np.array([t.isascii() for t in texts], dtype=bool), counts)
        lengths = np.where(whole, spans[1::2] - spans[::2], np.diff(self.decoded[1])[ids])
        return Tokens(ids, counts, lengths, gather(ids, *self.decoded).tobytes())


class PieceTokens:
    """Ids, byte lengths and bytes of texts, with the space that the tokenizer puts before them."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.single = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.decoded = _table([bytes([int(p[3:-1], 16)]) if b else p.replace(SPACE_MARK, " ").encode() for p, b in zip(pieces, self.single, strict=True)])
        # No piece goes on over a space: then each space between words ends a token.
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def encode(self, texts: list[str]) -> Tokens:
        found = self.model.encode(texts, num_threads=1, return_type="offset_mapping", return_bytes=True)
        ids, counts = _flat([f["ids"] for f in found])
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(f["offsets"] for f in found)), dtype=np.int64, count=2 * len(ids))
        lengths = np.where(self.single[ids], 1, spans[1::2] - spans[::2])
        first = (np.cumsum(counts) - counts)[counts > 0]
        lengths[first] += ~self.single[ids[first]]  # the space before a text has no span
        return Tokens(ids, counts, lengths, gather(ids, *self.decoded).tobytes())


class Tokens(NamedTuple):
    """Tokens of several texts, one after another."""

    ids: np.ndarray
    counts: np.ndarray  # tokens of each text
    lengths: np.ndarray  # bytes of each token's span
    decoded: bytes  # bytes of all tokens, by their spelling

    def of(self, kept: np.ndarray) -> Tokens:
        """Those of the texts that are ``kept``."""
        here = np.repeat(kept, self.counts)
        return Tokens(self.ids[here], self.counts[kept], self.lengths[here], b"")

    def faithful(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Of each text, whether its tokens' spans and spellings give the bytes of ``raw``."""
        begins = np.concatenate([[0], np.cumsum(self.counts)])
        spans, spelled = (np.concatenate([[0], np.cumsum(n)])[begins] for n in (self.lengths, sizes[self.ids]))
        same = [self.decoded[x:y] == r for r, x, y in zip(raw, spelled[:-1].tolist(), spelled[1:].tolist(), strict=True)]
        return np.array(same, dtype=bool) & (np.diff(spans) == np.diff(spelled)) & (np.diff(spans) > 0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())), counts


class Stretches:
    """Texts as numbers of stretches, each distinct one aligned once while remembered.

    Both tokenizers start a token at a single space between two characters that
    aren't white space (of the pieces, the vocabulary is asked), so a text's
    tokens, groups and links are those of its stretches, one after another.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevelTokens(byte_level), PieceTokens(pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        # Of each stretch: bytes of it and its groups, and uses (fewer count as time goes on).
        self.sizes, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # Of each stretch: tokens of a and b, groups, links; all 0 where a tokenizer doesn't give its bytes back.
        self.counts = np.zeros((4, 0), dtype=np.int64)
        self.links, self.begins = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def full(self) -> bool:
        return len(self.shown) > REMEMBERED or int(self.sizes.sum()) > REMEMBERED_BYTES

    def thin(self) -> None:
        """Forget all but those used most, more than once, up to half of what may be remembered."""
        most = np.argsort(-self.used, kind="stable")[: REMEMBERED // 2]
        most = most[(self.used[most] > 1) & (np.cumsum(self.sizes[most]) <= REMEMBERED_BYTES // 2)]
        kept = np.sort(most)
        names, shown = list(self.number), self.shown  # numbers are in order
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.shown = [shown[i] for i in kept.tolist()]
        self.links = gather(kept, self.links, self.begins)
        self.counts, self.sizes, self.used = self.counts[:, kept], self.sizes[kept], self.used[kept] >> 1
        self.begins = np.concatenate([[0], np.cumsum(self.counts[3])])

    def split(self, text: str) -> list[str]:
        if not self.b.by_word:
            return [text]
        odd = text.startswith(" ") or text.endswith(" ") or ODD_SPACES.search(text)
        return CUT.split(text) if odd else text.split(" ")

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The stretches of each text."""
        cut = [self.split(t) for t in texts]
        new = sorted(set(chain.from_iterable(cut)).difference(self.number))
        if new:
            self._learn(new)
        known = self.number.__getitem__
        return [np.fromiter(map(known, c), dtype=np.int64, count=len(c)) for c in cut]

    def _learn(self, new: list[str]) -> None:
        found = [self._aligned(new[i : i + LEARNED]) for i in range(0, len(new), LEARNED)]
        counts = np.concatenate([f[0] for f in found], axis=1)
        self.links = np.concatenate([self.links, *(f[1] for f in found)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts[3])])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.number.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        for _, _, shown, sizes in found:
            self.shown += shown
            self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])

    def _aligned(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of each of ``new``: counts, links (one after another), groups as shown, and bytes."""
        spaced = [f" {s}" for s in new]
        raw = [s.encode() for s in spaced]
        x, y = self.a.encode(spaced), self.b.encode(new)
        good = x.faithful(raw, np.diff(self.a.decoded[1])) & y.faithful(raw, np.diff(self.b.decoded[1]))
        counts, links = np.zeros((4, len(new)), dtype=np.int64), np.zeros(0, dtype=np.int64)
        shown = [b""] * len(new)
        if good.any():
            x, y = x.of(good), y.of(good)
            a_ends, b_ends = np.cumsum(x.lengths), np.cumsum(y.lengths)
            past = a_ends[np.cumsum(x.counts) - 1]  # where each stretch ends
            groups, segments, links, marks = aligned(x.ids, a_ends, y.ids, b_ends)
            per = [np.diff(np.searchsorted(at, past, side="right"), prepend=0) for at in (groups, segments)]
            counts[:, good] = x.counts, y.counts, *per
            table = _shown(1 << int(max(x.ids.max(), y.ids.max())).bit_length())
            text = gather(marks, *table).tobytes()
            ends = np.cumsum(np.diff(table[1])[marks])[np.cumsum(x.counts + y.counts) - 1].tolist()
            for i, start, end in zip(np.flatnonzero(good).tolist(), [0, *ends], ends):
                shown[i] = text[start:end]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(new)) + np.fromiter(map(len, shown), dtype=np.int64, count=len(new))
        return counts, links, shown, sizes


@cache
def _stretches(byte_level: bytes, pieces: bytes) -> Stretches:
    """One a worker process: what it has learned serves its next tasks too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would hold memory of its own
    return Stretches(byte_level, pieces)


def give_back() -> None:
    """Freed memory goes back to the system; else a worker process keeps most of the most it has had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings one after another, and where each begins: for gather()."""
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), dtype=np.int64, count=len(values)))])


@cache
def _shown(size: int) -> tuple[np.ndarray, np.ndarray]:
    """What code 4 * id + follower reads: the decimal id, and one of the four marks that may follow it."""
    return _table([b"%d%c" % (i, mark) for i in range(size) for mark in b",|,;"])


def aligned(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two token sequences over the same bytes -> where groups end, where links end, links as pairs (a id << 32 | b id), and the groups as codes of _shown().

    A group ends where tokens of both end; it reads ``a1,a2|b1;``.
    """
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two ascending runs
    again = ends[1:] == ends[:-1]
    common, segments = ends[1:][again], ends[np.concatenate([[True], ~again])]
    links = a_ids[np.searchsorted(a_ends, segments)] << 32 | b_ids[np.searchsorted(b_ends, segments)]
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=len(common))) for g in (a_group, b_group))
    # Tokens of a in a group come before those of b.
    shown = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    shown[np.arange(len(a_ids)) + np.concatenate([[0], b_upto])[a_group]] = a_ids * 4 + (a_ends == common[a_group])
    shown[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids * 4 + 2 + (b_ends == common[b_group])
    return common, segments, links, shown


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of non-empty texts, in runs of bounded size."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if run and size + len(t) > CHUNK_BYTES:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(t)
    if run:
        yield run


def _packed(lists: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """Lists of small numbers -> their lengths, and all of them compressed: Spark holds and moves a block as one row."""
    values = np.concatenate(lists).astype(np.int32)
    return np.array([len(x) for x in lists]), pa.compress(values, codec="zstd", asbytes=True)


def _unpacked(sizes: np.ndarray, packed: pa.Buffer) -> list[np.ndarray]:
    values = np.frombuffer(pa.decompress(packed, decompressed_size=4 * int(sizes.sum()), codec="zstd"), dtype=np.int32)
    return np.split(values, np.cumsum(sizes)[:-1])


def _block(number: int, doc_ids: list[int | None], texts: list[str | None], known: Stretches) -> dict:
    if known.full():
        known.thin()
    n = len(texts)
    counts = np.zeros((4, n), dtype=np.int64)
    hashes, found = [""] * n, [np.zeros(0, dtype=np.int64)] * n
    for run in _chunks(texts):
        for i, codes in zip(run, known.numbers([texts[i] for i in run]), strict=True):
            of_stretch = known.counts[:, codes]
            if of_stretch[0].all():
                counts[:, i], found[i] = of_stretch.sum(axis=1), codes
                text = b"".join(map(known.shown.__getitem__, codes.tolist()))
                hashes[i] = hashlib.sha256(memoryview(text)[:-1]).hexdigest()  # nothing follows the last group
    stretches, at = np.unique(np.concatenate(found), return_inverse=True)
    pairs, places = np.unique(gather(stretches, known.links, known.begins), return_inverse=True)
    widths, uses = known.counts[3, stretches], np.bincount(at, minlength=len(stretches))
    known.used[stretches] += uses
    totals = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(totals, places, np.repeat(uses, widths))
    sizes, packed = _packed([places, widths, at])
    return {
        "block": number, "doc_ids": doc_ids, "n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "n_links": counts[3], "hashes": hashes, "pairs": pairs, "totals": totals,
        "ends": np.cumsum(list(map(len, found))), "sizes": sizes, "packed": packed,
    }


def blocks(docs: DataFrame, byte_level: bytes, pieces: bytes) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> aligned documents, many a row: their counts, and their links by distinct pair."""
    longs = pa.list_(pa.int64())
    kinds = {"block": pa.int64(), "hashes": pa.list_(pa.string()), "packed": pa.binary()}
    names = [c.split()[0] for c in BLOCK.split(", ")]
    schema = pa.schema([(c, kinds.get(c, longs)) for c in names])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = _stretches(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > BLOCK_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_pylist([_block(number, ids[start : i + 1], texts[start : i + 1], known)], schema=schema)
                    give_back()
                    number, start, size = number + 1, i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, BLOCK)


def pair_counts(made: DataFrame) -> DataFrame:
    """Blocks -> (pair, count, best): links of each id pair over all documents; best where no pair of its b id has more."""
    pairs = made.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("totals").alias("n"))))
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` that end at ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


def _documents(rows: DataFrame) -> DataFrame:
    """Blocks with ``known`` (count and best of each of their pairs, in the pairs' order) -> a row per document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _stretches.cache_clear()  # the worker process aligns no more texts
        give_back()
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda c, row=row: batch.column(c)[row].values
                known = batch.column("known")[row].values
                count, best = (known.field(f).to_numpy(zero_copy_only=False).astype(np.int64) if known is not None else np.zeros(0, np.int64) for f in ("count", "best"))
                places, widths, stretches = _unpacked(column("sizes").to_numpy(), batch.column("packed")[row].as_buffer())
                ends = column("ends").to_numpy()
                # Pairs' figures summed by stretch, and those of its stretches by document.
                n_best, count_sum = (_sums(_sums(of[places], np.cumsum(widths))[stretches], ends) for of in (best, count))
                yield pa.RecordBatch.from_arrays(
                    [*(column(c) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), column("hashes")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return rows.mapInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_level_path: str = BYTE_LEVEL_PATH, pieces_path: str = PIECES_PATH) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text, ...) -> (documents, pairs).

    Documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256), a row per row of ``docs``. Null and empty texts, and those
    that either tokenizer doesn't give back byte by byte, have no tokens: zeros
    and an empty hash. Special tokens' strings are plain text. Repeated rows
    count each. Pairs: (pair, count, best), pair = a id << 32 | b id. An empty
    table gives empty results.
    """
    made = written(blocks(docs, read_file(byte_level_path), read_file(pieces_path)), "aligned", FILE_BLOCKS)
    counts = written(pair_counts(made), "counts")
    asked = made.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    # A block has a bounded number of pairs.
    known = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))
    return _documents(made.drop("pairs", "totals").join(known, "block", "left")), counts


def alignment_digest(docs: DataFrame) -> DataFrame:
    """The documents of align()."""
    return align(docs)[0]
