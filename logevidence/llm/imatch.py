"""I-Match fingerprints over randomised lexicons.

The lexicon is the terms whose inverse document frequency lies in a band. A
document's distinct lexicon terms are sorted and hashed once for each of
several random subsets of the lexicon. Subsets of several densities serve
short and long documents: a dense one sees a small change in a short text, a
thin one still agrees on long texts that differ here and there. Two documents
are as alike as the share of subsets on which their hashes agree, at the
density on which they agree most.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import global_rank, key_columns, written

# The band as shares of the documents a term is in (idf 2.3 to 6.9). The
# lexicon has at most (mean distinct terms a document) / LEAST_SHARE terms,
# however many documents there are.
LEAST_SHARE = 0.001
MOST_SHARE = 0.1
# Level -> random draws, and subsets of each. A draw deals the lexicon to
# 2 ** level subsets, of which so many are used; level 0 is the whole lexicon.
DRAWS = {0: (1, 1), 2: (2, 4), 4: (1, 8), 6: (1, 12), 8: (1, 12), 10: (1, 12)}
SUBSETS = {level: draws * subsets for level, (draws, subsets) in DRAWS.items()}
# Subsets with terms that a level needs to be judged by itself.
LEAST_SUBSETS = 3
HASH_DIGITS = 6

SPACE = "[ \\t-\\r]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words; none for null and empty texts."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame) -> DataFrame:
    """``texts`` (text) -> (term): hashes of the words in the band, over all rows."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    return counts.where((F.col("count") >= LEAST_SHARE * n) & (F.col("count") <= MOST_SHARE * n)).select("term")


def place(term: int, steps: list[int], size: int) -> int:
    """A term's one place in a table of ``size``: the steps of its lowest bits, each of a length of its own, from its start."""
    return (term >> 16) + steps[term & len(steps) - 1] * (term >> 40 & 0xFFFFFF | 1) & size - 1


def hash_table(terms: list[int]) -> tuple[list[int], list[int]]:
    """(steps, table), each 2 ** k longs: a term is in the table at its place, or nowhere.

    The terms of equal lowest bits take the first steps that find free places
    for all of them. A free place holds a number that belongs elsewhere.
    """
    size = 1 << max(2, (len(terms) + len(terms) // 4).bit_length())
    while True:
        groups: dict[int, list[int]] = defaultdict(list)
        for term in terms:
            groups[term & size // 4 - 1].append(term)
        steps, table = [0] * (size // 4), {}
        for low, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            for steps[low] in range(10_000):
                places = {place(term, steps, size): term for term in group}
                if len(places) == len(group) and table.keys().isdisjoint(places):
                    table |= places
                    break
            else:
                break
        else:
            at = place(0, steps, size)
            other = next(k << 16 for k in count(1) if place(k << 16, steps, size) != at)
            return steps, [table.get(i, other if i == at else 0) for i in range(size)]
        size *= 2


def _constant(longs: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<long>")  # folded to a constant once


def _fingerprints(found: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., _terms, _whole) -> (keep..., fingerprint).

    The hash of the sorted terms in each random subset, in hex, one after
    another; a mark where a subset has no term. A draw rehashes the terms: the
    low bits are a term's subset, and terms of unused subsets fall away at
    once. A text without a lexicon term hashes as a whole.
    """
    none = F.lit(42).cast("long")  # the hash of no terms is the hash's seed
    dealt = [(level, draw, n) for level, (draws, n) in DRAWS.items() for draw in range(draws)]

    def draw_terms(level: int, draw: int, n: int) -> Column:
        seed = F.lit(100 * level + draw)
        rehashed = F.transform(F.col("_terms"), lambda t: F.xxhash64(t, seed))
        return F.filter(rehashed, lambda u: u.bitwiseAND((1 << level) - 1) < n) if n < 1 << level else rehashed

    def digits(level: int, draw: int, k: int) -> Column:
        drawn = F.col(f"_draw_{level}_{draw}")
        subset = F.filter(drawn, lambda u: u.bitwiseAND((1 << level) - 1) == k) if level else drawn
        hashed = F.coalesce(F.nullif(F.xxhash64(subset), none), F.when(F.size("_terms") == 0, F.xxhash64("_whole", F.lit(1000 * level + 100 * draw + k))))
        return F.coalesce(F.lower(F.right(F.lpad(F.hex(hashed), 16, "0"), F.lit(HASH_DIGITS))), F.lit("-" * HASH_DIGITS))

    drawn = found.select(*keep, "_terms", "_whole", *(draw_terms(*d).alias(f"_draw_{d[0]}_{d[1]}") for d in dealt))
    return drawn.select(*keep, F.concat(*(digits(level, draw, k) for level, draw, n in dealt for k in range(n))).alias("fingerprint"))


def fingerprints(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` (text, ...) -> fingerprint and the other columns, row by row: nothing is shuffled.

    The terms of ``known`` come here, a bounded number, and go along as a hash
    table. It stands once in the plan, whose text the driver keeps.
    """
    keep = [c for c in texts.columns if c != "text"]
    steps, table = hash_table([r["term"] for r in known.collect()])
    steps_of, held = _constant(steps), _constant(table)

    def is_known(term: Column) -> Column:
        step = F.shiftright(term, 40).bitwiseAND(0xFFFFFF).bitwiseOR(1)
        at = F.shiftright(term, 16) + F.get(steps_of, term.bitwiseAND(len(steps) - 1).cast("int")) * step
        return F.get(held, at.bitwiseAND(len(table) - 1).cast("int")) == term

    mine = F.filter(terms(F.col("text")), is_known)
    found = texts.select(*keep, F.array_sort(mine).alias("_terms"), F.xxhash64(F.col("text"), F.lit("whole")).alias("_whole"))
    return _fingerprints(found, keep)


def likeness(a: Column, b: Column) -> Column:
    """Largest share, over the levels, of equal subset hashes among the subsets
    where either text has terms; over all subsets where no level has enough."""
    none = F.lit("-" * HASH_DIGITS)

    def part(x: Column, i: Column) -> Column:
        return F.substring(x, i * HASH_DIGITS + 1, F.lit(HASH_DIGITS))

    def share(first: int, n: int, least: int) -> Column:
        counted = F.filter(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: (part(a, i) != none) | (part(b, i) != none))
        same = F.filter(counted, lambda i: part(a, i) == part(b, i))
        return F.when(F.size(counted) >= least, F.size(same) / F.size(counted))

    firsts = [sum(list(SUBSETS.values())[:i]) for i in range(len(SUBSETS))]
    levels = [share(first, n, LEAST_SUBSETS) for first, n in zip(firsts, SUBSETS.values(), strict=True)]
    return F.coalesce(F.greatest(*levels), share(0, sum(SUBSETS.values()), 1), F.lit(1.0))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text) with the next one in ascending order of both keys, the first after the last.

    (id_key, text_key, n_chars, next_id, next_key): no texts. Rows of one
    doc_id follow each other by a hash of the text; equal rows count once.
    """
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    keys = docs.select(
        F.col("doc_id").isNotNull().alias("_has_id"), id_key.alias("id_key"), text_key.alias("text_key"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars")
    ).distinct()
    ranked = written(global_rank(keys, "_has_id", "id_key", "text_key").drop("_has_id"), "neighbours")
    n = max(1, ranked.count())
    following = ranked.select(F.pmod(F.col("_rank") - 1, F.lit(n)).alias("_rank"), F.col("id_key").alias("next_id"), F.col("text_key").alias("next_key"))
    return ranked.join(following, "_rank").drop("_rank")


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """-> (id_key, text_key, text, edited): the last quarter of a text replaced by as much of the next one's beginning."""
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    texts = docs.select(id_key.alias("id_key"), text_key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id_key", "text_key"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = order.select(F.col("id_key").alias("_id"), F.col("text_key").alias("_key"), quarter.alias("_quarter"), F.col("next_id").alias("id_key"), F.col("next_key").alias("text_key"))
    beginnings = texts.join(wanted, ["id_key", "text_key"]).select(
        F.col("_id").alias("id_key"), F.col("_key").alias("text_key"), "_quarter", F.left(F.col("text"), F.col("_quarter")).alias("_beginning")
    )
    rest = F.left(F.col("text"), F.char_length("text") - F.col("_quarter"))
    return texts.join(beginnings, ["id_key", "text_key"]).select("id_key", "text_key", "text", F.concat(rest, F.col("_beginning")).alias("edited"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Null texts count as empty; an empty table gives an empty result; a table
    of one document has itself as the next.
    """
    known = lexicon(docs.select("text"))
    order = written(neighbours(docs), "order")
    key = ["id_key", "text_key"]
    versions = (F.struct(F.lit(e).alias("is_edited"), F.col(c).alias("text")) for e, c in ((False, "text"), (True, "edited")))
    both = edited_texts(docs, order).select(*key, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(F.array(*versions)))
    found = written(fingerprints(both, known), "fingerprints")
    own = found.where("not is_edited").select(*key, "edited_sha256", "fingerprint")
    edited = found.where("is_edited").select(*key, F.col("fingerprint").alias("edited_fingerprint"))
    following = own.select(F.col("id_key").alias("next_id"), F.col("text_key").alias("next_key"), F.col("fingerprint").alias("_next"))
    rows = order.join(own, key).join(edited, key).join(following, ["next_id", "next_key"])
    shown = rows.select(
        *key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", id_key.alias("id_key"), text_key.alias("text_key")).join(shown, key).drop(*key)
