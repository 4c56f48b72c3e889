"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to levels that hold about equally
many rows, the curve index of a row's cell orders the rows, and the order is
cut into runs. Rows of a run are near each other in every dimension, so
minima and maxima of its files rule files out for filters on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logevidence.llm.common import global_rank, key_columns, written

BITS = 3
BINS = 1_024
SHARDS = 24
ROW_OVERHEAD = 8


def dimensions() -> dict[str, Column]:
    """The numbers that documents are ordered along, from their metadata.

    Names count by their first 7 bytes in code-point order, sizes by their
    logarithm; nulls are below all others.
    """

    def name(c: str) -> Column:
        return F.coalesce(F.conv(F.rpad(F.hex(F.left(F.col(c).cast("string").cast("binary"), F.lit(7))), 14, "0"), 16, 10).cast("double"), F.lit(-1.0))

    return {
        "source": name("source"),
        "lang": name("lang"),
        "size": F.log2(F.col("size").cast("double")),
        "doc_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)),
    }


def _levels(rows: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Replace each dimension by its level, 0 to 2**bits - 1.

    The range of a dimension is cut into BINS; the rows before a bin, over
    all rows, say its level. Both tables have a size fixed by the parameters.
    """
    ends = rows.agg(*(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max))).first()

    def bin_of(d: str) -> Column:
        low, high = ends[f"{d}_min"], ends[f"{d}_max"]
        if low is None or high <= low:
            return F.lit(0)
        return F.least(F.floor((F.col(d) - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")

    binned = rows.select(*(c for c in rows.columns if c not in dims), *(bin_of(d).alias(d) for d in dims))
    counted = binned.select(F.inline(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(d).alias("bin")) for i, d in enumerate(dims))))).groupBy("dim", "bin").count()
    by_dim = Window.partitionBy("dim")
    before = F.coalesce(F.sum("count").over(by_dim.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("count") / 2) / F.sum("count").over(by_dim)
    found = counted.select("dim", "bin", F.least(F.floor(middle * 2**bits), F.lit(2**bits - 1)).cast("int").alias("level")).collect()
    table = [[0] * BINS for _ in dims]
    for r in found:
        table[r["dim"]][r["bin"]] = r.level
    return binned.select(*(c for c in rows.columns if c not in dims), *(F.get(F.lit(table[i]), F.col(d)).alias(d) for i, d in enumerate(dims)))


def curve_cells(cells: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Add ``hilbert``: the curve index of a cell, from one level per dimension.

    Levels are turned into the transposed index: from the highest bit down,
    the lower bits of the first axis are inverted, or exchanged with another
    axis's, as that axis's bit says; Gray decoding follows, and the bits are
    interleaved.
    """
    axes = [f"_x{i}" for i in range(len(dims))]
    out = cells.select("*", *(F.col(d).cast("int").alias(a) for d, a in zip(dims, axes, strict=True)))
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, a in enumerate(axes):
            is_set = F.col(a).bitwiseAND(1 << b) != 0
            if i == 0:
                out = out.withColumn(a, F.when(is_set, F.col(a).bitwiseXOR(low)).otherwise(F.col(a)))
                continue
            swap = F.col(axes[0]).bitwiseXOR(F.col(a)).bitwiseAND(low)
            out = out.withColumns({
                axes[0]: F.when(is_set, F.col(axes[0]).bitwiseXOR(low)).otherwise(F.col(axes[0]).bitwiseXOR(swap)),
                a: F.when(is_set, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap)),
            })
    for before, a in zip(axes, axes[1:], strict=False):
        out = out.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    flips = F.lit(0)
    for b in range(bits - 1, 0, -1):
        flips = F.when(F.col(axes[-1]).bitwiseAND(1 << b) != 0, flips.bitwiseXOR((1 << b) - 1)).otherwise(flips)
    out = out.withColumn("_flips", flips)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in axes:
            index = index * 2 + F.shiftright(F.col(a).bitwiseXOR(F.col("_flips")), b).bitwiseAND(1)
    return out.withColumn("hilbert", index).drop(*axes, "_flips")


def all_cells(like: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Every cell with its curve index: 2**(bits * dimensions) rows."""
    cells = like.sparkSession.range(1 << bits * len(dims), numPartitions=1)
    levels = [F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(d) for i, d in enumerate(dims)]
    return curve_cells(cells.select(*levels), dims, bits)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) -> metadata, shard, slot, a row per row.

    Law: rows. Row counts of the shards differ by one at most; ``slot`` counts
    a shard's rows from 0 without a gap along the curve. Rows of a cell are in
    order of doc_id, then of a hash of the text, so any hot cell, source or
    group of copies is cut like the rest. Null texts have no bytes; null names
    and ids come before all others. An empty table gives an empty result.
    """
    raw = F.col("text").cast("binary")
    id_key, text_key = key_columns(F.col("doc_id"), F.col("text"))
    metadata = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
        id_key.alias("id_key"),
        text_key.alias("text_key"),
        "source",
        "lang",
    )
    wanted = dimensions()
    dims = [f"_{d}" for d in wanted]
    rows = written(metadata.select("doc_id", "size", "text_crc32", "id_key", "text_key", *(c.alias(f"_{d}") for d, c in wanted.items())), "metadata")
    cells = all_cells(rows, dims, bits)
    # One row per cell, a number fixed by the parameters.
    placed = _levels(rows, dims, bits).join(F.broadcast(cells), dims).drop(*dims)
    ranked = global_rank(placed, "hilbert", "id_key", "text_key")
    total = rows.count()
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("_shard", shard)
        .withColumn("slot", F.col("_rank") - first)
        .select("doc_id", "size", "text_crc32", "id_key", "text_key", "hilbert", F.col("_shard").cast("int").alias("shard"), "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_a_file: int = 1_000_000) -> None:
    """Write ``docs`` with all columns in shard order: the files of a shard are runs of its slots."""
    placed = hilbert_shards(docs, shards).groupBy("id_key", "text_key").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("_places"))
    id_key, text_key = key_columns(F.col("_row.doc_id"), F.col("_row.text"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    # Equal rows are one row with the places of all.
    once = packed.select("_row", id_key.alias("id_key"), text_key.alias("text_key")).dropDuplicates(["id_key", "text_key"])
    rows = once.join(placed, ["id_key", "text_key"]).select("_row", F.inline("_places"))
    ordered = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    ordered.select("_row.*").write.option("maxRecordsPerFile", rows_a_file).parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    rows = hilbert_shards(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
