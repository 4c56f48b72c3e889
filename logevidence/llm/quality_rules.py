"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Documents
are counted by their vote pattern over the whole table, expectation
maximisation on those counts estimates how each rule votes on good and on bad
documents, and a document's posterior probability of being good decides.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import SPACE_BYTES, word_batches, written

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower")

_MIX = np.random.default_rng(7).integers(1, 2**63, size=WINDOW_WORDS, dtype=np.uint64) | np.uint64(1)


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(codes: np.ndarray, window: int = WINDOW_WORDS) -> int:
    """Words that stand in a window of ``window`` words (a power of two) found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        hashes += mixed[k : k + n] * _MIX[k]
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():  # different hashes: different windows
        return 0
    # Exact names of the windows of 2, 4, 8 words.
    names, width = codes.astype(np.int64), 1
    while width < window:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        names, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * width
    twice = np.bincount(names)[names] >= 2
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_features(raw: bytes | None) -> tuple[int, ...]:
    """The FEATURES of one text; all 0 for a null or empty one."""
    if not raw:
        return (0,) * len(FEATURES)
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    codes = np.concatenate([np.fromiter(map(index.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in word_batches(raw)])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(codes),
        len(raw.translate(None, SPACE_BYTES + CONTINUATION)),
        _count(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(lines),
        len(index),
        _count(raw, UPPER),
        _count(raw, LOWER),
    )


def features_column(text: Column) -> Column:
    @F.arrow_udf("struct<" + ", ".join(f"{f}: long" for f in FEATURES) + ">")
    def features(texts: pa.Array) -> pa.Array:
        rows = [text_features(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts.cast(pa.binary())]
        columns = np.array(rows, dtype=np.int64).reshape(-1, len(FEATURES)).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list(FEATURES))

    return features(text)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(f: Column) -> dict[str, Column]:
    """Every rule's vote on the features ``f``."""
    n, letters = f.n_words, f.n_upper + f.n_lower
    return {
        "symbols": _vote(good=20 * f.n_symbols <= n, bad=5 * f.n_symbols > n),
        "capitals": _vote(good=(10 * f.n_upper < letters), bad=(letters >= 20) & (3 * f.n_upper > letters)),
        "repeated_words": _vote(good=(n >= MIN_WORDS) & (f.n_repeat_words == 0), bad=4 * f.n_repeat_words > n),
        # Distinct words grow about as the root of the length in running text.
        "distinct_words": _vote(good=f.n_distinct_words > 3 * F.sqrt(n), bad=(n >= MIN_WORDS) & (f.n_distinct_words < 2 * F.sqrt(n))),
        "repeated_lines": _vote(good=(f.n_lines >= 3) & (f.n_dup_lines == 0), bad=3 * f.n_dup_lines > f.n_lines),
        "word_length": _vote(good=(f.word_chars >= 3 * n) & (f.word_chars <= 10 * n), bad=(n > 0) & ((f.word_chars < 2 * n) | (f.word_chars > 15 * n))),
        "length": _vote(good=n >= 50, bad=n < MIN_WORDS),
    }


RULES = ("symbols", "capitals", "repeated_words", "distinct_words", "repeated_lines", "word_length", "length")
# Every vote pattern by its code: base 3, first rule lowest, digits vote + 1.
PATTERNS = np.array(list(itertools.product((-1, 0, 1), repeat=len(RULES))))[:, ::-1]

# What is taken to hold before any document is seen, and what share of the
# table that knowledge weighs. A document is good or has mostly one fault.
GOOD_PRIOR = 0.85
VOTES_IF_GOOD = (0.002, 0.25, 0.748)  # shares of -1, 0, 1
VOTES_IF_FAULTY = (0.95, 0.04, 0.01)  # of the rule for that fault
VOTES_IF_OTHER_FAULT = (0.05, 0.3, 0.65)  # of another rule
PRIOR_SHARE = 0.1
# A rule's votes on its own fault: the whole of that weight for each fault, not only the fault's part of it, else the
# class of a rare fault comes to mean the documents that its rule says nothing about.
OWN_FAULT_SHARE = PRIOR_SHARE


@dataclass
class RuleModel:
    share: np.ndarray  # of the good class, then of the fault of each rule
    votes: np.ndarray  # class x rule x vote + 1
    posterior: np.ndarray  # probability of a good document by pattern code

    def accuracy(self, rule: str) -> float:
        """Share of a rule's votes that agree with the estimated class."""
        j = RULES.index(rule)
        cast = self.share[:, None] * self.votes[:, j, :]
        return float((cast[0, 2] + cast[1:, 0].sum()) / (cast[:, 0].sum() + cast[:, 2].sum()))


def pattern(cast: dict[str, Column]) -> Column:
    return sum(((cast[r] + 1) * 3**j for j, r in enumerate(RULES)), F.lit(0))


def fit(voted: DataFrame, rounds: int = 500) -> RuleModel:
    """Expectation maximisation over all rows of ``voted`` (``pattern`` int).

    The table is counted by vote pattern: 3 to the power of the rules at most
    (2,187), whatever its size. The latent classes are good and one fault per
    rule; votes are independent given the class. An empty table gives the prior.
    """
    n = np.zeros(len(PATTERNS))
    for r in voted.groupBy("pattern").count().collect():
        n[r["pattern"]] = r["count"]
    k = len(RULES)
    start = np.array([[VOTES_IF_GOOD if c == 0 else VOTES_IF_FAULTY if c == j + 1 else VOTES_IF_OTHER_FAULT for j in range(k)] for c in range(k + 1)])
    first = np.array([GOOD_PRIOR] + [(1 - GOOD_PRIOR) / k] * k)
    weight = 1 + PRIOR_SHARE * n.sum()
    is_vote = np.stack([PATTERNS == x for x in (-1, 0, 1)], axis=2).astype(float)  # pattern x rule x vote

    def classes(share: np.ndarray, table: np.ndarray) -> np.ndarray:
        odds = np.log(share) + np.einsum("pjv,cjv->pc", is_vote, np.log(table))
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    own = np.arange(1, k + 1), np.arange(k)
    share, table = first, start
    for _ in range(rounds):
        held = classes(share, table) * n[:, None]
        counts = held.sum(axis=0) + weight * first
        seen = np.einsum("pc,pjv->cjv", held, is_vote) + weight * first[:, None, None] * start
        seen[own] += OWN_FAULT_SHARE * n.sum() * np.array(VOTES_IF_FAULTY)
        now = counts / counts.sum(), seen / seen.sum(axis=2, keepdims=True)
        moved = max(np.abs(now[0] - share).max(), np.abs(now[1] - table).max())
        share, table = now
        if moved < 1e-9:
            break
    return RuleModel(share, table, classes(share, table)[:, 0])


def base_failed(f: Column) -> Column:
    return (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words)


def _judged(model: RuleModel, f: Column) -> tuple[Column, Column]:
    """Posterior probability of a good document, and the verdict."""
    posterior = F.get(F.lit(model.posterior.tolist()), pattern(votes(f)))
    return posterior, ~base_failed(f) & (posterior >= KEEP_AT)


def _voted(rows: DataFrame) -> DataFrame:
    return rows.select(pattern(votes(F.col("_f"))).alias("pattern"))


def quality_digest(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> counts, base_failed, kept, posterior: a row per document.

    Null and empty texts have no words, fail the base and aren't kept. Rows of
    one doc_id are judged each by its text.
    """
    rows = written(docs.select("doc_id", features_column(F.col("text")).alias("_f")), "features")
    model = fit(_voted(rows))
    f = F.col("_f")
    posterior, kept = _judged(model, f)
    shown = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *shown, base_failed(f).alias("base_failed"), kept.alias("kept"), posterior.alias("posterior"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null and empty texts go, as they fail the base; repeated rows stay or go
    together; an empty table gives an empty result. Features are counted once
    and written with the rows.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = written(packed.select("_row", features_column(F.col("_row.text")).alias("_f")), "features")
    model = fit(_voted(rows))
    return rows.where(_judged(model, F.col("_f"))[1]).select("_row.*")
