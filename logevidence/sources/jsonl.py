"""S-06..S-09 readers and K-01..K-04 writers for the stage interchange files (JSON Lines)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_stem
from ..schemas import CHUNK, CHUNK_FIELDS, EMBEDDING, EMBEDDING_FIELDS, EVENT, EVENT_FIELDS
from ..operators.ordinal import ordinal_within
from .files import read_lines


class RecordError(ValueError):
    """A line that holds no record of its stage, named by file and line."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """Records with a closed schema. Blank lines are skipped (F-10); with FAILFAST a
    malformed line fails the job. ``mode='PERMISSIVE'`` adds ``_corrupt_record``."""
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", mode.upper()).json(path)


def bad_records(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    """``source_path, source_file, line_number, raw`` of the lines under ``path`` that hold no record of ``schema``.

    Lines are those of the JSON reader (line feeds and carriage returns), counted
    from 1 in each file; blank ones are no records and no errors (F-10).
    """
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = read_lines(spark, path, patterns=(pattern,), recursive=True, boundaries="\r")
    record = F.from_json("raw", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where((F.trim("raw") != "") & record["_corrupt_record"].isNotNull())


@contextmanager
def naming_bad_records(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*") -> Iterator[None]:
    """Turn a reader's failure inside the block into a RecordError that names the first bad line in (path, line) order.

    Good input pays nothing: lines are numbered only after a failure.
    """
    try:
        yield
    except Exception as exc:
        if not any(c in str(exc) for c in ("MALFORMED_RECORD", "FAILED_READ_FILE")):
            raise
        at = F.min(F.struct("source_path", "line_number", "source_file", "raw"))
        bad = bad_records(spark, path, schema, pattern).agg(at.alias("m")).first()["m"]
        if bad is None:
            raise
        raise RecordError(f"invalid record in {bad['source_file']}:{bad['line_number']} -> {bad['raw'][:200]!r}") from exc


def load_events(spark, path, mode="FAILFAST"):
    """S-06."""
    return read_jsonl(spark, path, EVENT, mode)


def load_chunks(spark, path, mode="FAILFAST"):
    """S-07."""
    return read_jsonl(spark, path, CHUNK, mode)


def load_embedding_records(spark, path, mode="FAILFAST"):
    """S-08."""
    return read_jsonl(spark, path, EMBEDDING, mode)


# File suffixes of the stage interchange files (S-09).
STAGE_SUFFIX = {"events": ".events.jsonl", "chunks": ".chunks.jsonl", "embeddings": ".embeddings.jsonl"}
STAGE_SCHEMA = {"events": EVENT, "chunks": CHUNK, "embeddings": EMBEDDING}


def stage_input(spark: SparkSession, folder: str, stage: str, mode: str = "FAILFAST") -> DataFrame:
    """S-09: every ``*<stage suffix>`` file under ``folder`` (recursively) as one DataFrame.

    A missing folder or a folder without such files is an error; an empty file
    is legal and contributes no rows. Column ``stem`` is the file name without
    the suffix (the per-file grouping key of the next stage).
    """
    suffix = STAGE_SUFFIX[stage]
    sc = spark.sparkContext
    hp = sc._jvm.org.apache.hadoop.fs.Path(folder)
    if not hp.getFileSystem(sc._jsc.hadoopConfiguration()).exists(hp):
        raise FileNotFoundError(f"input folder does not exist: {folder}")
    schema = STAGE_SCHEMA[stage]
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    reader = (spark.read.schema(schema).option("mode", mode.upper()).option("recursiveFileLookup", "true")
              .option("pathGlobFilter", f"*{suffix}"))
    try:
        df = reader.json(folder)
    except Exception as exc:  # no file matched the glob
        raise FileNotFoundError(f"no *{suffix} files under {folder}") from exc
    if not df.inputFiles():
        raise FileNotFoundError(f"no *{suffix} files under {folder}")
    stem = F.expr(f"left(_metadata.file_name, length(_metadata.file_name) - {len(suffix)})")
    return df.withColumn("stem", stem).withColumn("stage_file", F.col("_metadata.file_path"))


def write_jsonl(df: DataFrame, path: str, fields, per_file: str | None = "source_file") -> None:
    """K-01/K-03/K-04: one JSON object per line, null keys written, non-ASCII kept.

    With ``per_file`` set, records land under ``file=<stem>/`` (the record itself
    keeps every key).
    """
    out = df.select(*fields)
    w = out
    if per_file:
        w = out.withColumn("file", path_stem(F.col(per_file)))
    writer = w.write.mode("overwrite").option("ignoreNullFields", "false")
    if per_file:
        writer = writer.partitionBy("file")
    writer.json(path)


def write_events(df, path):
    write_jsonl(df, path, EVENT_FIELDS)


def write_chunks(df, path):
    write_jsonl(df, path, CHUNK_FIELDS)


def write_embeddings(df, path):
    write_jsonl(df, path, EMBEDDING_FIELDS)


def write_json_array(df: DataFrame, path: str, fields=EVENT_FIELDS, key: str = "source_file",
                     order: str = "line_number") -> None:
    """K-02: the ``json`` format, one JSON array per file, without gathering a file in one row.

    Each record becomes one text line ``[{..},`` / ``{..},`` / ``{..}]``; rows are
    range-partitioned by (file, position) and sorted, so under ``file=<stem>/``
    the part files concatenated in name order are the array.
    """
    pos = ordinal_within(df, [key], order, out="__p", total="__n")
    js = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    first, last = F.col("__p") == 0, F.col("__p") == F.col("__n") - 1
    line = F.concat(F.when(first, F.lit("[")).otherwise(F.lit("")), js, F.when(last, F.lit("]")).otherwise(F.lit(",")))
    rows = pos.select(path_stem(F.col(key)).alias("file"), F.col("__p"), line.alias("value"))
    rows.repartitionByRange("file", "__p").sortWithinPartitions("file", "__p").select("file", "value").write.mode(
        "overwrite"
    ).partitionBy("file").text(path)
