import hashlib
import json
import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logevidence.llm import bpe, simple8b, token_store
from logevidence.llm.pretokens import Splitter, gather
from logevidence.llm.token_store import TokenIds

ODD = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85  'stvemrld.,!ab1½中éé\U0001f600"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    return bpe._encoding(bpe.read_ranks())


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_pieces_encode_as_the_whole_text(text):
    encoding, splitter = bpe._encoding(bpe.read_ranks()), Splitter(bpe.public_tokenizers.PATTERN)
    codes = gather(np.array(splitter.split(text)), *splitter.offsets())
    names = list(splitter.pieces)
    assert "".join(names[c] for c in codes) == text
    assert [i for c in codes for i in encoding.encode_ordinary(names[c])] == encoding.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_token_ids_as_the_tokenizer(texts):
    content = token_store.read_tokenizer()
    whole = Tokenizer.from_buffer(content)
    whole.encode_special_tokens = True
    flat, ends = TokenIds(content).encode(texts)
    assert [x.tolist() for x in np.split(flat, ends)[:-1]] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


END_OF_TEXT = "<|endoftext|>"
HOLDING = ["a <|endoftext|> b", END_OF_TEXT, 2 * END_OF_TEXT, "<|endoftext|> a", "wo<|endoftext|>rd", "a  <|endoftext|>  b\n", "", "<|endoftext| >", "<|endof<|endoftext|>text|>", "plain text", "\n<|endoftext|>\n\n<|endoftext|>'s"]


def test_added_tokens_as_the_tokenizer():
    content = token_store.read_tokenizer()
    whole = Tokenizer.from_buffer(content)
    for texts in (HOLDING, HOLDING[::-1], *([t] for t in HOLDING)):
        flat, ends = TokenIds(content).encode(texts)
        assert [x.tolist() for x in np.split(flat, ends)[:-1]] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(ODD, st.just(END_OF_TEXT)), max_size=5).map("".join), max_size=4))
def test_added_tokens_in_odd_texts(texts):
    content = token_store.read_tokenizer()
    whole = Tokenizer.from_buffer(content)
    flat, ends = TokenIds(content).encode(texts)
    assert [x.tolist() for x in np.split(flat, ends)[:-1]] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_with_added_tokens(spark):
    whole, at, wanted = Tokenizer.from_file(token_store.TOKENIZER_PATH), 0, []
    for doc_id, text in enumerate(HOLDING):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    docs = spark.createDataFrame(list(enumerate(HOLDING)), "doc_id long, text string")
    assert sorted(tuple(r) for r in token_store.token_file_digest(docs).collect()) == wanted


def test_added_tokens_of_other_kinds_are_refused():
    file = json.loads(token_store.read_tokenizer())
    file["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="lstrip"):
        token_store.added_tokens(json.dumps(file).encode())
    assert token_store.added_tokens(b"{}") == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_257), st.integers(0, 2**32 - 1)), max_size=600))
def test_simple8b_round_trip(values):
    width, words, escapes = simple8b.encode(np.array(values, dtype=np.uint64))
    assert len(words) % 8 == 0 and simple8b.decode(width, words, escapes).tolist() == values


def test_simple8b_is_compact():
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(100_000) < 0.02, rng.integers(0, 2**32, 100_000), rng.integers(0, 4_000, 100_000))
    width, words, escapes = simple8b.encode(ids)
    assert escapes and len(words) + len(escapes) < 2 * len(ids)
    assert (simple8b.decode(width, words, escapes) == ids).all()
    assert len(simple8b.encode(np.zeros(24_000))[1]) == 8 * 100


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["edge", "clashing", "empty", "small"])
def test_bpe_as_tiktoken(name, request, tiktoken_encoding):
    docs = request.getfixturevalue(name)
    wanted = []
    for doc_id, text in rows_of(docs):
        ids = tiktoken_encoding.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in bpe.round_trip_digest(docs).collect())


def test_many_blocks(small, monkeypatch, tiktoken_encoding):
    """Blocks and buckets are cut anew in the tasks' own code, so the sizes are set through it."""
    monkeypatch.setattr(bpe, "BUCKET_PIECES", 500)
    got = {r.doc_id: r.ids for r in bpe.encode(small.repartition(40)).collect()}
    assert got == {i: tiktoken_encoding.encode_ordinary(t) for i, t in rows_of(small)}


def test_decode_null_and_empty(spark):
    rows = bpe.decode(spark.createDataFrame([(1, [72, 105]), (2, []), (3, None)], "k int, ids array<int>")).collect()
    table = {v: k for k, v in bpe._ranks(bpe.read_ranks()).items()}
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in rows] == [table[72] + table[105], b"", None]


@pytest.mark.parametrize("name", ["clashing", "empty", "small"])
def test_token_files(name, request):
    docs = request.getfixturevalue(name)
    whole, at, wanted = Tokenizer.from_file(token_store.TOKENIZER_PATH), 0, []
    for doc_id, text in sorted(rows_of(docs)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.token_file_digest(docs).collect()) == wanted


def test_token_files_edge(edge):
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in token_store.token_file_digest(edge).collect())
    assert len(rows) == edge.count() and rows[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
    ids = [r[2] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_files_are_in_order(spark, small):
    import pyarrow.parquet as pq
    from pathlib import Path

    path = tempfile.mkdtemp(prefix="logevidence-test-") + "/ids"
    token_store.write_token_files(small, path)
    found = [i for f in sorted(Path(path).glob("part-*.parquet")) for ids in pq.read_table(f).column("doc_ids").to_pylist() for i in ids]
    assert found == sorted(i for i, _ in rows_of(small))


def test_stretches_are_numbered_as_they_come():
    """One look at each stretch: no second pass over a text's new ones, in an order of its own."""
    splitter, names = Splitter(bpe.public_tokenizers.PATTERN), [f"w{'abcdefgh'[i % 8]}{i}" for i in range(300)]
    assert splitter.split(" ".join(names)) == list(range(300))
    assert splitter.split(" ".join([names[0], *names[:0:-1]])) == [0, *range(299, 0, -1)]
    assert splitter.split(f"new {names[0]}, {names[1]}") == [300, 301, 1] and len(splitter) == 302
