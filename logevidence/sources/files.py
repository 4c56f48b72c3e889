"""S-01..S-05: discover log files and read them as numbered lines.

Two reading modes:

* ``scale`` (default): the text source, split at line feeds; each row is then
  split at the other Python line boundaries, so lines equal ``str.splitlines``.
  Files are split into blocks and read in parallel; gzip files are one block
  each. The 1-based line number comes from ``monotonically_increasing_id`` over
  the split lines (consecutive inside a block) plus the number of lines in the
  earlier blocks of the same file, taken from a per-block count table (one row
  per block). No window ever spans a whole file.
* ``exact``: ``binaryFile`` + decode + split on every Python line boundary.
  Matches ``str.splitlines`` and supports single-byte/UTF-16 encodings, but
  each file must fit in one row (< 2 GB).

Spark's file sources leave out files and folders with names starting with
``.`` or ``_``; ``check_hidden_files`` raises for log files there.
"""

from __future__ import annotations

import codecs
import fnmatch
import gzip
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import LINE_BREAK_IN_ROW, split_lines

# Files whose blocks (one row per block) are broadcast; those of more files are joined.
MAX_BROADCAST_FILES = 10_000

# Rows end at line feeds only; the other boundaries are found in the decoded rows.
LINE_FEED = "\n"


def _brace(patterns: Sequence[str]) -> str:
    pats = [p for p in patterns if p]
    if not pats:
        raise ValueError("at least one file pattern is required")
    return pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}"


def _reader(spark: SparkSession, fmt: str, patterns: Sequence[str], recursive: bool):
    """The files of a folder whose names match; in flat mode its own files only, never those of a sub-folder."""
    return spark.read.format(fmt).option("pathGlobFilter", _brace(patterns)).option("recursiveFileLookup", str(recursive).lower())


def _left_out(name: str, folder: bool = False) -> bool:
    """Spark's rule for the names of files and folders that its file sources pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _refuse(hidden: list[str]) -> None:
    if hidden:
        raise ValueError(f"log files with names that Spark does not read, rename them: {sorted(hidden)[:5]}")


def check_hidden_names(paths: Sequence[str]) -> None:
    """check_hidden_files() for an explicit file list: there only the files' own names count."""
    _refuse([p for p in paths if _left_out(p.rsplit("/", 1)[-1])])


def check_hidden_files(spark: SparkSession, root: str, patterns: Sequence[str], recursive: bool) -> None:
    """Raise for matching files that Spark's file sources would leave out, by their own name or a folder's below ``root``."""
    sc = spark.sparkContext
    hp = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = hp.getFileSystem(sc._jsc.hadoopConfiguration())
    roots = [hp] if fs.exists(hp) else [st.getPath() for st in fs.globStatus(hp) or ()]
    if not roots:
        raise FileNotFoundError(f"input folder does not exist: {root}")
    hidden, folders = [], [(p, "") for p in roots]
    while folders and len(hidden) < 5:
        folder, within = folders.pop()  # ``within``: the path below a folder that is left out
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            shown = f"{within}{name}"
            if st.isDirectory():
                if recursive:
                    folders.append((st.getPath(), f"{shown}/" if within or _left_out(name, folder=True) else ""))
            elif (within or _left_out(name)) and not name.endswith(".crc") and any(fnmatch.fnmatchcase(name, p) for p in patterns):
                hidden.append(shown)
    _refuse(hidden)


def discover_log_files(spark: SparkSession, root: str, patterns: Sequence[str] = ("*.log",), *,
                       recursive: bool = False) -> DataFrame:
    """S-01/U-01/T-05: ``path, name, length`` of matching files, deduplicated, sorted by path.

    Only file metadata is read (the content column is pruned). Matching files
    that Spark would leave out are an error.
    """
    check_hidden_files(spark, root, patterns, recursive)
    df = _reader(spark, "binaryFile", patterns, recursive).load(root)
    return (
        df.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")
        .dropDuplicates(["path"])
        .orderBy("path")
    )


def _load_text(spark, paths, patterns, recursive):
    if isinstance(paths, str):
        return _reader(spark, "text", patterns, recursive).option("lineSep", LINE_FEED).load(paths)
    return spark.read.format("text").option("lineSep", LINE_FEED).load(list(paths))


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, patterns: Sequence[str] = ("*.log", "*.gz"),
               recursive: bool = False, encoding: str = "utf-8", boundaries: str = LINE_BREAK_IN_ROW) -> DataFrame:
    """S-03/S-04 scale mode: ``source_path, source_file, line_number, raw``.

    ``paths`` is a folder (discovered with ``patterns``; names may hold any
    character) or an explicit file list. Bytes that are not valid UTF-8 become
    replacement characters; another ``encoding`` must be one whose line feeds
    are single bytes (Latin and most others; not UTF-16: see ``read_lines_exact``).
    ``boundaries`` is the pattern of line boundaries beside the line feed.
    """
    text = _load_text(spark, paths, patterns, recursive)
    return number_lines(text.select("value", "_metadata"), encoding, boundaries)


def _plain_name(encoded):
    """Spark's file metadata has names URL-encoded; a plus sign stands for itself there."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def _decoder(encoding: str):
    """Decoding that Spark's own charsets leave out, a batch at a time."""

    @pandas_udf(T.StringType())
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return decoded


def number_lines(text: DataFrame, encoding: str = "utf-8", boundaries: str = LINE_BREAK_IN_ROW) -> DataFrame:
    """Number the lines of a text scan (columns ``value`` and ``_metadata``, ``lineSep`` LINE_FEED) per file.

    A row has the lines between its line boundaries, most often one. Inside one
    block the lines of a task are consecutive, so ``mid - first_mid`` is the
    offset in the block; earlier blocks of the same file contribute their
    line counts through an exclusive prefix sum over the block table (one row per
    block). Up to :data:`MAX_BROADCAST_FILES` files it is broadcast, so that the
    lines are not shuffled for their numbers. Names are decoded once per block.

    A carriage return before the line feed, or at the file's end, belongs to
    it. A last row without a line feed has no empty line after a boundary at its
    end: whether there is one shows in the file's size (not of compressed
    files, whose last line feed is taken for granted).
    """
    name = codecs.lookup(encoding).name
    if name.startswith(("utf-16", "utf-32")):
        raise ValueError(f"{encoding} needs read_lines_exact")
    if name == "utf-8":
        raw = F.make_valid_utf8("value")
    elif name == "iso8859-1":
        raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    else:
        raw = _decoder(name)(F.col("value").cast("binary"))
    rows = text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.octet_length("value") + 1).cast("long").alias("size"),
        F.when(raw.endswith("\r"), F.left(raw, F.length(raw) - 1)).otherwise(raw).alias("row"),
        raw.endswith("\r").alias("returned"),
    )
    parts = F.when(F.col("row").rlike(boundaries), F.split("row", boundaries, -1)).otherwise(F.array("row"))
    # Counted below the explode: beside it, every line would split its whole row again.
    split = rows.withColumn("pieces", parts).withColumn("parts", F.size("pieces"))
    lines = split.select("file_path", "file_name", "block", "file_size", "size", "returned", "parts", F.posexplode("pieces").alias("part", "raw"))
    scan = lines.withColumn("mid", F.monotonically_increasing_id())
    blocks = scan.groupBy("file_path", "file_name", "block").agg(
        F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"), F.max("mid").alias("last_mid"),
        F.sum(F.when(F.col("part") == 0, F.col("size"))).alias("bytes"), F.max("file_size").alias("file_size"),
    )
    in_file = Window.partitionBy("file_path")
    before = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Rows count a line feed each; a byte order mark (3 bytes) isn't among the rows' bytes.
    over = F.sum("bytes").over(in_file) - F.col("file_size")
    offs = blocks.select(
        "file_path", "block", _plain_name(F.col("file_path")).alias("source_path"), _plain_name(F.col("file_name")).alias("source_file"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_mid") + 1).alias("delta"),
        F.when((F.col("block") == F.max("block").over(in_file)) & over.isin(1, -2), F.col("last_mid")).alias("open_mid"),
    )
    after_boundary = (F.col("part") == F.col("parts") - 1) & (F.col("part") > 0) & (F.col("raw") == "") & ~F.col("returned")
    if 0 < len(text.inputFiles()) <= MAX_BROADCAST_FILES:
        offs = F.broadcast(offs)
    return scan.drop("file_name").join(offs, on=["file_path", "block"], how="inner").where(
        ~(after_boundary & F.col("mid").eqNullSafe(F.col("open_mid")))
    ).select("source_path", "source_file", (F.col("mid") + F.col("delta")).alias("line_number"), "raw")


@pandas_udf(T.BinaryType())
def _maybe_gunzip(path: pd.Series, content: pd.Series) -> pd.Series:
    """Decompress ``.gz`` files (any case); other contents pass through."""
    out = []
    for p, b in zip(path, content):
        if b is not None and str(p).lower().endswith(".gz"):
            b = gzip.decompress(bytes(b))
        out.append(b)
    return pd.Series(out, dtype=object)


def read_lines_exact(spark: SparkSession, paths: str | Sequence[str], *, encoding: str = "utf-8",
                     patterns: Sequence[str] = ("*.log", "*.gz"), recursive: bool = False) -> DataFrame:
    """S-03/S-04 exact mode (``str.splitlines`` boundaries, any Spark-supported charset)."""
    if isinstance(paths, str):
        files = _reader(spark, "binaryFile", patterns, recursive).load(paths)
    else:
        files = spark.read.format("binaryFile").load(list(paths))
    content = _maybe_gunzip(F.col("path"), F.col("content"))
    enc = encoding.lower().replace("_", "-")
    text = F.make_valid_utf8(content.cast("string")) if enc in ("utf-8", "utf8") else F.decode(content, encoding)
    lines = files.select(
        F.col("path").alias("source_path"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("source_file"),
        F.posexplode(split_lines(text)).alias("pos", "raw"),
    )
    return lines.select("source_path", "source_file", (F.col("pos") + 1).cast("long").alias("line_number"), "raw")


def existing_files(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """S-05: split an explicit file list into (present, missing); missing ones are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present, missing = [], []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        (present if fs.exists(hp) and fs.getFileStatus(hp).isFile() else missing).append(p)
    return present, missing
