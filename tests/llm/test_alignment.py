import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logevidence.llm import alignment as al

ODD = [
    "a <|endoftext|> b<s>c</s> <unk> <0x41>",
    "日本𝒳語 é▁x  y",
    "日本𝒳語 é x  y\n\n\t z \U0001f600\U0001f468‍\U0001f469 é",
    " leading and trailing  ",
    "\x00 control \x7f \x1f\r\n",
    "don't  stop 12,345.67 — ½ naïve façade",
    "ﬁ ligature ＡＢＣ full width   nbsp 　 wide",
    "x" * 300 + " 中" * 40,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def shown_bytes():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, k = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + k)] = b
            k += 1
    return table


def brute(libraries, texts):
    """A row per text, by the whole-text libraries and sets of bytes."""
    a, b = libraries
    byte_of, rows, links = shown_bytes(), [], []
    for text in texts:
        row, mine = (0, 0, 0, 0, ""), []
        if text:
            x = a.encode(" " + text, add_special_tokens=False)
            y = b.encode(text)
            parts = [bytes(byte_of[c] for c in t) for t in x.tokens]
            others = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, map(b.id_to_piece, y))]
            if b"".join(parts) == b"".join(others) == (" " + text).encode():
                spans = []
                for ids, pieces in ((x.ids, parts), (y, others)):
                    at, out = 0, []
                    for i, p in zip(ids, pieces):
                        out.append((at, at + len(p), i))
                        at += len(p)
                    spans.append(out)
                j = 0
                for s, e, i in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(spans[1]) and spans[1][k][0] < e:
                        mine.append((i, spans[1][k][2]))
                        k += 1
                cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                groups, left, right = [], iter(spans[0]), iter(spans[1])
                for cut in cuts:
                    sides = []
                    for side in (left, right):
                        ids = []
                        for _, e, i in side:
                            ids.append(str(i))
                            if e == cut:
                                break
                        sides.append(",".join(ids))
                    groups.append("|".join(sides))
                row = (len(spans[0]), len(spans[1]), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append(row)
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    most = {}
    for (_, i), k in count.items():
        most[i] = max(k, most.get(i, 0))
    return [(*r[:4], sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine), r[4]) for r, mine in zip(rows, links)]


def check(docs, libraries):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = [(i, *row) for (i, _), row in zip(source, brute(libraries, [t for _, t in source]))]
    got = al.alignment_digest(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_small_table(small, libraries, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_BYTES", 40_000)
    check(small.repartition(3), libraries)


def test_edge_cases(edge, clashing, empty, libraries):
    check(edge, libraries)
    check(clashing, libraries)
    assert al.alignment_digest(empty).count() == 0


def test_odd_texts(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    check(docs, libraries)
    rows = {r.doc_id: r for r in al.alignment_digest(docs).collect()}
    assert rows[0].n_a > 0 and rows[1].n_a == 0 == rows[1].n_links and rows[1].groups_sha256 == ""


def test_pairs(spark, libraries):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog")], "doc_id long, text string")
    pairs = al.align(docs)[1].collect()
    a, b = libraries
    the = a.encode(" the").ids[0] << 32 | b.encode("the")[0]
    assert {r.pair: r["count"] for r in pairs}[the] == 3


def test_forgetting_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(al, "REMEMBERED", 3)
    known = al.Stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH))
    for number, text in enumerate(ODD * 2):
        row = al._block(number, [1, 2], [text, text], known)
        wanted = brute(libraries, [text])[0]
        for c, of_row in zip(("n_a", "n_b", "n_groups", "n_links"), wanted):
            assert row[c].tolist() == [of_row] * 2
        assert row["hashes"] == [wanted[6]] * 2


def test_stretches_are_those_of_whole_texts(libraries, monkeypatch):
    known = al.Stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH))
    parts = ["a", "of", "don't", "12", "é", "中", "\n", "\t", " ", "  ", "x.", "\u00a0", "\u3000", "<s>", "\U0001f600", "(ab)", "\x1c", "\u2028"]
    mixer = random.Random(5)
    texts = [mixer.choice(["", " "]).join(mixer.choices(parts, k=mixer.randint(1, 12))) for _ in range(3_000)]
    cut = al._block(0, list(range(len(texts))), texts, known)
    wanted = brute(libraries, texts)
    assert cut["n_links"].tolist() == [r[3] for r in wanted] and cut["hashes"] == [r[6] for r in wanted]
    assert sum(r[3] > 0 for r in wanted) > 500


def test_stretches_go_through_the_tokenizers_in_bounded_runs(libraries, monkeypatch):
    monkeypatch.setattr(al, "LEARNED", 50, raising=False)
    known, most = al.Stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH)), []
    for side in (known.a, known.b):
        monkeypatch.setattr(side, "encode", lambda texts, encode=side.encode: most.append(len(texts)) or encode(texts))
    texts = [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(20)] + ODD
    row = al._block(0, list(range(len(texts))), texts, known)
    assert max(most) <= 50 and sum(most) == 2 * len(known.number)
    assert row["hashes"] == [r[6] for r in brute(libraries, texts)]


def test_stretches_in_use_stay_remembered(libraries, monkeypatch):
    monkeypatch.setattr(al, "REMEMBERED", 100)
    known = al.Stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH))
    common = [f"common{i}" for i in range(30)]
    for k in range(6):
        texts = [" ".join(common * 2 + [f"rare{k}x{i}" for i in range(90)])] * 2 + ["common1 日本𒆳語"]
        row = al._block(k, [1, 2, 3], texts, known)
        wanted = brute(libraries, texts)
        assert row["hashes"] == [r[6] for r in wanted] and row["n_links"].tolist() == [r[3] for r in wanted]
        assert len(known.number) == len(known.shown) == len(known.used) == len(known.sizes) == known.counts.shape[1] <= 200
        known.thin()
        assert set(common) <= set(known.number) and len(known.number) <= 50
    monkeypatch.setattr(al, "REMEMBERED_BYTES", 100)
    known.thin()
    assert known.sizes.sum() <= 50 and not known.full()


def test_blocks_are_small_rows_and_few_a_file(spark, small, monkeypatch):
    text = [r.text for r in small.where("length(text) > 500").limit(40).collect()]
    known = al.Stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH))
    row = al._block(0, list(range(len(text))), text, known)
    places, widths, stretches = al._unpacked(row["sizes"], al.pa.py_buffer(row["packed"]))
    assert widths.sum() == len(places) and len(stretches) == row["ends"][-1] and places.max() < len(row["pairs"])
    assert len(row["packed"]) < 4 * row["sizes"].sum() / 1.5
    assert al._unpacked(al.np.zeros(3, dtype=int), al.pa.py_buffer(al._packed([[], [], []])[1]))[2].tolist() == []
    rows = spark.range(50, numPartitions=1)
    assert len(al.written(rows, "few", 16).inputFiles()) == 4 and al.written(rows, "few", 16).count() == 50
    assert len(al.written(rows, "all").inputFiles()) == 1


def test_a_worker_uses_one_thread(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    al._stretches.cache_clear()
    al._stretches(al.read_file(al.BYTE_LEVEL_PATH), al.read_file(al.PIECES_PATH))
    assert al.os.environ["TOKENIZERS_PARALLELISM"] == "false"
    al._stretches.cache_clear()
