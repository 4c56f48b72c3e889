"""Near-duplicates by SetSketch registers.

A register keeps the least of the exponential variates that a set's elements
draw for it, as a whole step of a geometric scale, cut off at both ends. So
the registers of a union are the larger ones of its parts, and two sets agree
in a register about as often as their Jaccard similarity. Sets that agree in
all registers of a band are candidates; the likelihood of how many registers
are larger, smaller and equal, given both sizes, judges a candidate; the full
sets confirm it.

Groups of candidates aren't compared pair by pair. Each group holds its
members against one pivot, and what is linked counts as one component from
then on. The few members that stay outside of the pivot's component meet all
members of the group where it lies; only links leave that join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import key_columns, word_batches, written
from logevidence.llm.components import stars
from logevidence.llm.sparse_terms import raw_texts

SHINGLE_WORDS = 4
# Linked: PER_CENT or more of the union is common.
PER_CENT = 80

# A pair at the least similarity misses all bands once in 1.5e9.
BANDS = 40
BAND_REGISTERS = 4
REGISTERS = BANDS * BAND_REGISTERS
# The scale: steps of BASE; variates of rate RATE; registers 0 to LIMIT, two bytes each.
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
# A candidate goes if the least similarity is e ** SLACK times less likely than the likeliest: once in 4e9 wrongly.
SLACK = 20.0
BLOCK = 512
# Words of 64 bits that tell from below how many elements two sets differ in.
PARITY_WORDS = 16

_hash = partial(xxhash.xxh64_intdigest, seed=SHINGLE_WORDS)
_PLACES = np.array([_hash(b"place %d" % i) | 1 for i in range(SHINGLE_WORDS)], dtype=np.uint64)
_LOW = np.array([_hash(b"low %d" % i) & 0xFFFFFFFF | 1 for i in range(REGISTERS)], dtype=np.uint32)
_HIGH = np.array([_hash(b"high %d" % i) & 0xFFFFFFFF | 1 for i in range(REGISTERS)], dtype=np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ codes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    codes = (codes ^ codes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ codes >> np.uint64(32)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of the whole sequence where it is shorter; none without words."""
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    pieces, carry = [], np.zeros(0, dtype=np.uint64)
    for batch in word_batches(raw.lower()):  # bytes.lower changes A-Z only
        words = np.concatenate([carry, np.fromiter(map(_hash, batch), dtype=np.uint64, count=len(batch))])
        n = len(words) - SHINGLE_WORDS + 1
        if n > 0:
            codes = sum(words[i : i + n] * place for i, place in enumerate(_PLACES))
            pieces.append(np.unique(_mixed(codes)))
            carry = words[n:]
        else:
            carry = words
    if pieces:
        return pieces[0] if len(pieces) == 1 else np.unique(np.concatenate(pieces))
    return _mixed((carry * _PLACES[: len(carry)]).sum(keepdims=True) + np.uint64(len(carry))) if len(carry) else carry


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes; of no elements all zero."""
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    low, high = elements.astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(elements), BLOCK):
        drawn = _LOW[:, None] * low[None, start : start + BLOCK]
        drawn += _HIGH[:, None] * high[None, start : start + BLOCK]
        np.minimum(least, drawn.min(axis=1), out=least)
    if not len(elements):
        return np.zeros(REGISTERS, dtype=np.uint16)
    variates = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variates) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def _ahead(share: np.ndarray) -> np.ndarray:
    """Chance that one set's register is larger, from the share that only it has of both sizes together."""
    return -np.log1p(-np.maximum(share, 0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(jaccard: np.ndarray, larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of registers larger and smaller in the first of two sets of ``n`` and ``m`` elements."""
    u, v = n / (n + m), m / (n + m)
    up, down = _ahead(u - v * jaccard), _ahead(v - u * jaccard)
    tiny = np.finfo(float).tiny
    terms = ((larger, up), (smaller, down), (REGISTERS - larger - smaller, 1 - up - down))
    return sum(k * np.log(np.maximum(p, tiny)) for k, p in terms)


def plausible(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the similarity may be PER_CENT: it is estimated by maximum likelihood, jointly with both sizes."""
    low, high = np.zeros(len(n)), np.minimum(n / m, m / n)
    for _ in range(60):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(a, larger, smaller, n, m) < log_likelihood(b, larger, smaller, n, m)
        low, high = np.where(left, a, low), np.where(left, high, b)
    best, bound = (low + high) / 2, np.full(len(n), PER_CENT / 100)
    near = log_likelihood(best, larger, smaller, n, m) - log_likelihood(bound, larger, smaller, n, m) <= SLACK
    return (100 * np.minimum(n, m) >= PER_CENT * np.maximum(n, m)) & ((best >= bound) | near)


def common_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def parities(elements: np.ndarray) -> np.ndarray:
    """Of each of so many buckets of hashes whether the set has an odd count there, as longs.

    Two sets differ in no fewer elements than in bits.
    """
    odd = np.bincount((elements % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, id_key, text_key, n, set_id, sketch), a row per document.

    ``set_id`` is a 128-bit hash of the shingle set, ``sketch`` its registers,
    a long for each band; both are null without shingles. Null and empty texts
    have none.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw) for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "id_key", "text_key")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "id_key", "text_key", "n", "set_id", "sketch"],
            )

    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key.alias("id_key"), text_key.alias("text_key"), "text")
    return keyed.mapInArrow(sketched, "doc_id long, id_key long, text_key long, n long, set_id binary, sketch array<long>")


def groups(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, sketch) -> (bucket, band, node): the groups of equal bands that have two nodes or more.

    A bucket is a hash of the band's number and registers: an accidental one
    is a candidate that isn't confirmed.
    """
    dealt = nodes.select("node", F.posexplode("sketch").alias("band", "_registers")).select("node", "band", F.xxhash64("_registers", "band").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1").select("bucket")
    return dealt.join(shared, "bucket").select("bucket", "band", "node")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, id_key, text_key) -> (node, elements, parity): the sorted shingle hashes, from the texts, and their parities()."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw) for raw in raw_texts(batch.column("text"))]
            arrays = ([s.view(np.int64) for s in sets], [parities(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(a, pa.list_(pa.int64())) for a in arrays)], names=["node", "elements", "parity"])

    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    texts = docs.select(id_key.alias("id_key"), text_key.alias("text_key"), "text").join(wanted, ["id_key", "text_key"])
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(elements, "node long, elements array<long>, parity array<long>")


def shared_counts(sets: DataFrame) -> DataFrame:
    """``sets`` (node, elements, parity) -> (node, shared, parity): elements that another node has too.

    Two nodes have no more in common than the smaller of their counts. Nodes
    that no other can be similar to aren't returned.
    """
    alone = sets.select("node", F.explode("elements").alias("_e")).groupBy("_e").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("_k")).where("_k = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("_own"))
    counted = sets.select("node", "parity", F.size("elements").cast("long").alias("n")).join(own, "node", "left").withColumn("shared", F.col("n") - F.coalesce("_own", F.lit(0)))
    return counted.where(F.col("shared") * 100 >= F.col("n") * PER_CENT).select("node", "shared", "parity")


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and shared counts allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.least(f"{a}.shared", f"{b}.shared", n, m)
    return common * 100 >= (n + m - common) * PER_CENT


def _parities_allow(a: str, b: str) -> Column:
    """Whether the sets may differ in few enough elements."""
    differ = sum(F.bit_count(F.get(f"{a}.parity", F.lit(i)).bitwiseXOR(F.get(f"{b}.parity", F.lit(i)))) for i in range(PARITY_WORDS))
    return differ * (100 + PER_CENT) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - PER_CENT)


def least_equal() -> int:
    """Equal registers that a pair at the least similarity has, but for once in 4e9 times."""
    s = PER_CENT / 100
    share = np.arange(1, REGISTERS) / REGISTERS
    unlikely = REGISTERS * (share * np.log(share / s) + (1 - share) * np.log((1 - share) / (1 - s))) > SLACK
    return int((unlikely & (share < s)).sum()) + 1


def _folded(shift: int) -> Callable[[Column], Column]:
    return lambda d: d.bitwiseOR(F.shiftrightunsigned(d, shift))


def _registers_allow(a: str, b: str) -> Column:
    """Whether this band is the first that is equal, so that a pair counts in one group only, and enough registers are."""
    first = F.lit(True)
    for i in range(BANDS - 1):
        first = first & ((F.col(f"{a}.band") <= i) | (F.get(f"{a}.sketch", F.lit(i)) != F.get(f"{b}.sketch", F.lit(i))))
    differ = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: x.bitwiseXOR(y))
    for step in (_folded(8), _folded(4), _folded(2), _folded(1)):  # all bits of a register come together in its lowest
        differ = F.transform(differ, step)
    unequal = F.aggregate(differ, F.lit(0), lambda n, d: n + F.bit_count(d.bitwiseAND(F.lit(0x0001000100010001))))
    return first & (unequal <= REGISTERS - least_equal())


def judged(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (u, v) -> those whose sketches allow the similarity."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for c in ("sketch_u", "sketch_v"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_u", "n_v"))
            yes = plausible((a > b).sum(axis=1), (a < b).sum(axis=1), n, m)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes)) for c in ("u", "v")], names=["u", "v"])

    known = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("u", "v")]
    return pairs.join(known[0], "u").join(known[1], "v").mapInArrow(kept, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (u, v) -> those whose full sets are similar. ``sets`` has (node, elements).

    The sets of v go to those of u; a u with very many v's is split by Spark's skew handling.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                common = common_elements(a, b)
                yes.append(100 * common >= PER_CENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes, pa.bool_())) for c in ("u", "v")], names=["u", "v"])

    a, b = (sets.select(F.col("node").alias(c), F.col("elements").alias(e)) for c, e in (("u", "a"), ("v", "b")))
    return pairs.join(b, "v").join(a, "u").mapInArrow(linked, "u long, v long")


def _rooted(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` (node, ...) with ``root``, by the stars ``found``: the smallest node of the component, the node itself where nothing is linked to it."""
    if found is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(found.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(members: DataFrame, nodes: DataFrame, found: DataFrame | None, salt: int) -> DataFrame:
    """-> (bucket, band, node, root, n, shared, p): the members of groups of several components, each with the group's pivot.

    The pivot has the largest share of elements in common with others; of
    equal ones, that of the least hash of this round. After the first round,
    only the hash counts.
    """
    labelled = written(_rooted(members.join(nodes.select("node", "n", "shared"), "node"), found), "labelled")
    own = (F.col("n") - F.col("shared")) / F.col("n") if salt == 0 else F.lit(0.0)
    pivot = F.min(F.struct(own.alias("_own"), F.xxhash64("node", F.lit(salt)).alias("_order"), "node", "root", "n", "shared"))
    pivots = labelled.groupBy("bucket").agg(pivot.alias("p"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("bucket", "p")
    return labelled.join(pivots, "bucket")


def _against_pivots(open_members: DataFrame) -> DataFrame:
    """(u, v): each open node v with one pivot u of its groups."""
    met = open_members.alias("a").where(F.col("root") != F.col("p.root")).where(_may_link("a", "p"))
    return met.groupBy("node").agg(F.min("p").alias("p")).select(F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v")).distinct()


def _across(open_members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): all links inside of groups between different components, compared where the group meets.

    Of such a pair one is outside of the pivot's component: those meet all
    members. Counts, parities and registers rule out most pairs; only members of which some
    pair is left, on either side, bring their full sets.
    """
    rows = open_members.withColumn("main", F.col("p.root")).drop("p").join(nodes.select("node", "sketch", "parity"), "node")
    rows = written(rows, "open")
    outside = rows.where("root != main")
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    allowed = (F.col("a.bucket") == F.col("b.bucket")) & apart & _may_link("a", "b") & _parities_allow("a", "b") & _registers_allow("a", "b")
    hopeful = written(outside.alias("a").join(rows.hint("merge").alias("b"), allowed, "left_semi"), "hopeful")
    met = written(rows.alias("b").join(hopeful.hint("merge").alias("a"), allowed, "left_semi"), "met")
    left, right = (x.join(sets.select("node", "elements"), "node").alias(name) for x, name in ((hopeful, "a"), (met, "b")))
    common = F.size(F.array_intersect("a.elements", "b.elements"))
    similar = common * 100 >= (F.col("a.n") + F.col("b.n") - common) * PER_CENT
    return left.join(right.hint("merge"), allowed & similar).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """``nodes`` (node, id_key, text_key, n, sketch) -> (u, v): what confirmed links connect, as stars around smallest nodes; None without any.

    A link inside of what others connect may be missing, none between two
    components is. Rounds of pivots go on while most of their pairs are links;
    each adds its links to the stars of those before.
    """
    members = written(groups(nodes), "groups")
    grouped = nodes.join(members.select("node").distinct(), "node")
    sets = written(_full_sets(docs, grouped.select("node", "id_key", "text_key")), "sets")
    nodes = written(grouped.select("node", "n", "sketch").join(shared_counts(sets), "node"), "grouped")
    if nodes.isEmpty():
        return None
    found, salt = None, 0
    while True:
        open_members = _open(members, nodes, found, salt)
        pairs = written(_against_pivots(open_members), "pairs")
        new = written(confirmed(judged(pairs, nodes), sets), "links")
        tried, linked = pairs.count(), new.count()
        if linked:
            found = stars(new if found is None else found.unionByName(new))
        if 2 * linked <= tried:
            break
        salt += 1
    rest = written(_across(_open(members, nodes, found, salt + 1), nodes, sets), "links")
    if rest.isEmpty():
        return found
    return stars(rest if found is None else found.unionByName(rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, id_key, text_key, n, root, component_id), a row per document.

    Words are lower-cased in A-Z; a set has the distinct shingles. Texts of one
    set are one node; null, empty and wordless texts have no shingles and link
    with nothing: their ``root`` is null and ``component_id`` their doc_id.
    ``component_id`` is the smallest doc_id of the component, null if it has
    none. Repeated rows stay, in one component. An empty table gives an empty
    result.
    """
    rows = written(sketches(docs), "sketches")
    first = F.min(F.struct("id_key", "text_key", "n", "sketch", "doc_id")).alias("first")
    nodes = rows.where("n > 0").groupBy("set_id").agg(first, F.min("doc_id").alias("first_id"))
    nodes = written(nodes.select("set_id", F.monotonically_increasing_id().alias("node"), "first.id_key", "first.text_key", "first.n", "first.sketch", "first_id"), "sets")
    found = links(nodes.select("node", "id_key", "text_key", "n", "sketch"), docs)
    named = nodes.select("set_id", "node", "first_id")
    if found is None:
        named = named.select("set_id", F.col("node").alias("root"), F.col("first_id").alias("component_id"))
    else:
        rooted = written(_rooted(named, found), "roots")
        named = rooted.select("set_id", "root").join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    full = rows.select("doc_id", "id_key", "text_key", "n", "set_id").join(named, "set_id", "left")
    return full.select("doc_id", "id_key", "text_key", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; a null doc_id is kept where its component has no other."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
