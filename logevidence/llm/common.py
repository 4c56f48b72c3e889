"""Helpers shared by the operators: inputs, written tables, ranks, words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logevidence.session import shared_dir

# Arrow batches are bounded by rows and by bytes, so that a run of long texts
# does not make one large batch.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# Words are runs of bytes other than these (also what bytes.split() splits on).
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACES = re.compile(rb"[\x20\x09-\x0D]")
# Texts longer than this are taken apart piece by piece, whole.
PIECE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    here, and lost executors lose nothing of it. Files of large rows hold
    ``file_rows`` of them at most."""
    path = shared_dir(df.sparkSession, name)
    limit = {"maxRecordsPerFile": file_rows} if file_rows else {}
    df.write.options(compression="zstd", **limit).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_buckets(df: DataFrame, name: str, column: str) -> DataFrame:
    """written(), as a table bucketed by ``column``: a later join or grouping by
    it does not shuffle these rows again. The table's files are in the shared
    folder; its name is new each time."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def key_columns(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs, never null, that a row is found again by: its id, and a hash
    that tells rows of one id apart by their text. A null id or text has a
    key of its own."""
    return F.coalesce(doc_id.cast("long"), F.lit(0)), F.xxhash64(text, text.isNull(), doc_id.isNull())


def bounded_sample(df: DataFrame, limit: int, key: str) -> DataFrame:
    """About ``limit`` rows at most, drawn evenly by a hash of ``key``; all rows of ``df`` if there are fewer."""
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Add ``_rank``: the row's place from 0 in the order of ``order``.

    Rows are range-partitioned and sorted, so a hot leading value is cut by
    the next column. Ranks come from the place in the partition plus the rows
    of the partitions before; that table has one row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = (
        placed.groupBy(part.alias("_part"))
        .agg((F.max(at) + 1).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    # One row per partition of the range shuffle.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn("_rank", F.col("_before") + at)
        .drop("_part", "_before", "_at")
    )


def word_batches(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw`` in order, in lists from pieces of bounded size."""
    if len(raw) <= PIECE_BYTES:
        yield raw.split()
        return
    start = 0
    while start < len(raw):
        gap = SPACES.search(raw, min(start + PIECE_BYTES, len(raw)))
        end = gap.start() if gap else len(raw)
        yield raw[start:end].split()
        start = end
