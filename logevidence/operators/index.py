"""E-04 core: the vector index as a versioned parquet table (X-04, K-05, P-19..P-21, S-10, S-11).

Layout under ``<root>/<collection>``:

* ``points-<unique>/part=<p>/`` - the parts that one attempted upsert has touched, whole;
* ``_meta/v=<n>.json`` - one JSON row per commit (version, each part's folder, metric, dim, model).

A point's part is a hash of its id, so an upsert reads and rewrites only the
parts that its ids fall into: there it is ``current LEFT ANTI new UNION new``,
written to a folder of its own; all other parts stay where they are. Creating
``v=<n>.json``, which fails if it exists, is the commit. Readers take the
highest committed version, so a failed or half-written upsert is never
visible, and of two writers one commits and the other one raises. Only a
missing ``_meta`` folder means an empty index; any other read error is raised.
Vectors that are null or not of the index's length are refused. Ids are never deleted
(stale ids survive a re-chunk unless ``replace_files`` is given).
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_metric
from ..functions.events import citation
from ..schemas import INDEX_EXTRA_FIELDS, INDEX_POINT_FIELDS
from ..session import shared_dir

# Parts of a new index: at 100 TB of points choose so many that one is some GB.
PARTS = 64

POINT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("document", T.StringType(), True),
        T.StructField("source_file", T.StringType(), True),
        T.StructField("line_start", T.LongType(), True),
        T.StructField("line_end", T.LongType(), True),
        T.StructField("ts_start", T.StringType(), True),
        T.StructField("ts_end", T.StringType(), True),
        T.StructField("embedding_model", T.StringType(), True),
        T.StructField("embedding_dim", T.IntegerType(), True),
        T.StructField("sev_info", T.IntegerType(), True),
        T.StructField("sev_warning", T.IntegerType(), True),
        T.StructField("sev_error", T.IntegerType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("sources", T.ArrayType(T.StringType()), True),
        T.StructField("backends", T.ArrayType(T.StringType()), True),
    ]
)

META = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("folders", T.MapType(T.StringType(), T.StringType())),
        T.StructField("committed_at", T.DoubleType()),
    ]
)


def _sev(name: str):
    return F.coalesce(F.try_element_at(F.col("severities"), F.lit(name)), F.lit(0)).cast("int")


def index_points(records: DataFrame, extra=()) -> DataFrame:
    """P-19/P-21: embedding records -> index rows (flat metadata, sentinels, citation)."""
    has = set(records.columns)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    i = lambda c: F.coalesce(F.col(c), F.lit(-1))
    extras = [
        (F.col(c) if c in has else F.lit(None).cast(POINT[c].dataType)).alias(c) for c in INDEX_EXTRA_FIELDS
    ]
    return records.select(
        F.col("chunk_id").alias("id"),
        F.col("embedding"),
        citation("source_file", "line_start", "line_end").alias("document"),
        s("source_file").alias("source_file"),
        i("line_start").cast("long").alias("line_start"),
        i("line_end").cast("long").alias("line_end"),
        s("ts_start").alias("ts_start"),
        s("ts_end").alias("ts_end"),
        s("embedding_model").alias("embedding_model"),
        i("embedding_dim").cast("int").alias("embedding_dim"),
        _sev("info").alias("sev_info"),
        _sev("warning").alias("sev_warning"),
        _sev("error").alias("sev_error"),
        *extras,
        *extra,
    )


def dedup_last(points: DataFrame, order_col: str | None = None) -> DataFrame:
    """Within one load a repeated id keeps its last row (by ``order_col``, else scan order)."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    return _dedup_by(points, order)


def _dedup_by(points: DataFrame, order) -> DataFrame:
    cols = [c for c in points.columns]
    packed = points.select("id", F.struct(order.alias("__o"), F.struct(*cols).alias("r")).alias("__s"))
    return packed.groupBy("id").agg(F.max("__s").alias("__s")).select("__s.r.*")


def upsert_frames(current: DataFrame, new: DataFrame, replace_files: bool = False) -> DataFrame:
    """K-05 / J-03: points after loading ``new`` into ``current`` (by id, never deleting)."""
    kept = current.join(new.select("id"), on="id", how="left_anti")
    if replace_files:
        kept = kept.join(new.select("source_file").distinct(), on="source_file", how="left_anti")
    return kept.unionByName(new)


class VectorIndex:
    """X-04: ``upsert`` / ``count`` / ``query`` over a versioned parquet point table."""

    def __init__(self, spark: SparkSession, root: str, collection_name: str = "logevidence",
                 similarity_metric: str = "cosine", parts: int = PARTS):
        """``parts`` counts when the index is created; an existing one keeps its own."""
        if parts < 1:
            raise ValueError("parts must be > 0")
        self.spark = spark
        self.parts = parts
        self.path = f"{root.rstrip('/')}/{collection_name}"
        self.metric = check_metric(similarity_metric)

    # -- metadata ---------------------------------------------------------
    def _hadoop(self, path: str):
        sc = self.spark.sparkContext
        hp = sc._jvm.org.apache.hadoop.fs.Path(path)
        return hp, hp.getFileSystem(sc._jsc.hadoopConfiguration())

    def _meta(self):
        folder, fs = self._hadoop(f"{self.path}/_meta")
        if not fs.exists(folder):
            return None
        m = self.spark.read.schema(META).option("mode", "FAILFAST").json(f"{self.path}/_meta")
        return m.orderBy(F.col("version").desc()).first()

    def _next_version(self) -> int:
        """One above every version file, also one that a writer left empty."""
        folder, fs = self._hadoop(f"{self.path}/_meta")
        names = [st.getPath().getName() for st in fs.listStatus(folder)] if fs.exists(folder) else []
        return 1 + max((int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json")), default=-1)

    def _commit(self, meta: dict) -> None:
        """Create the version's file; raises if another writer has."""
        target, fs = self._hadoop(f"{self.path}/_meta/v={meta['version']}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer committed version {meta['version']} of {self.path}") from e
        out.write(bytearray((json.dumps(meta) + "\n").encode()))
        out.close()

    def open(self, meta=None) -> "VectorIndex":
        """S-11: open or create; the stored metric must equal the requested one."""
        meta = self._meta() if meta is None else meta
        if meta is not None and meta["metric"] != self.metric:
            raise ValueError(f"index {self.path} uses metric {meta['metric']!r}, not {self.metric!r}")
        return self

    def version(self) -> int:
        meta = self._meta()
        return -1 if meta is None else int(meta["version"])

    def _points_of(self, meta, parts=None) -> DataFrame:
        """The points of all parts, or of some."""
        folders = {} if meta is None else meta["folders"]
        paths = [f"{self.path}/{folder}/part={p}" for p, folder in sorted(folders.items()) if parts is None or int(p) in parts]
        return self.spark.read.schema(POINT).parquet(*paths) if paths else self.spark.createDataFrame([], POINT)

    def points(self) -> DataFrame:
        return self._points_of(self._meta())

    def count(self) -> int:
        """S-10."""
        return self.points().count()

    def upsert(self, records: DataFrame, order_col: str | None = None, replace_files: bool = False) -> int:
        """K-05: load embedding records; returns the committed version (unchanged if empty).

        The new points are written first, so that an encoder runs once. With
        ``replace_files`` every part may hold points of those files, and all
        are rewritten.
        """
        meta = self._meta()
        self.open(meta)
        current = -1 if meta is None else int(meta["version"])
        parts = self.parts if meta is None else int(meta["parts"])
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        more = (order_col,) if order_col else ()
        new = index_points(records, extra=more) if "chunk_id" in records.columns else records
        new = dedup_last(new.select(*POINT.fieldNames(), *more), order_col).select(*POINT.fieldNames())
        loaded = shared_dir(self.spark, "index-load")
        new.write.parquet(loaded)
        new = self.spark.read.schema(POINT).parquet(loaded)
        # One small aggregate: the dimensions and models present (at most two kept), the parts, and bad vectors.
        info = new.agg(
            F.slice(F.array_sort(F.collect_set("embedding_dim")), 1, 2).alias("dims"),
            F.slice(F.array_sort(F.collect_set("embedding_model")), 1, 2).alias("models"),
            F.collect_set(part).alias("parts"),
            F.count_if(F.coalesce(F.size("embedding") != F.col("embedding_dim"), F.lit(True)) | F.col("embedding").isNull()).alias("bad"),
        ).first()
        dims, models = list(info["dims"] or []), list(info["models"] or [])
        if not dims:  # empty payload is a no-op
            return current
        if len(dims) > 1 or (meta is not None and meta["dim"] is not None and dims[0] != meta["dim"]):
            raise ValueError(f"embedding dimension mismatch: {dims} vs index {meta['dim'] if meta else None}")
        if info["bad"]:
            raise ValueError(f"{info['bad']} records have no vector of {dims[0]} numbers")
        if len(models) > 1 or (meta is not None and meta["model"] and models and models[0] != meta["model"]):
            raise ValueError(f"embedding model mismatch: {models} vs index {meta['model'] if meta else None}")
        folders = {} if meta is None else dict(meta["folders"])
        touched = set(info["parts"]) | ({int(p) for p in folders} if replace_files else set())
        v, folder = self._next_version(), f"points-{uuid.uuid4().hex}"
        merged = upsert_frames(self._points_of(meta, touched), new, replace_files).withColumn("part", part)
        # Ranges of files: row groups hold few files, so source_file filters skip the others.
        order = ("part", "source_file", "id")
        merged.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        # A part whose points were all replaced away has no folder of its own.
        target, fs = self._hadoop(f"{self.path}/{folder}")
        written = {st.getPath().getName() for st in fs.listStatus(target)}
        for p in touched:
            folders.pop(str(p), None)
            if f"part={p}" in written:
                folders[str(p)] = folder
        self._commit({"version": v, "metric": self.metric, "dim": int(dims[0]), "model": models[0] if models else None, "parts": parts, "folders": folders, "committed_at": time.time()})
        return v

    def query(self, vector, top_k: int = 5, where=None):
        from .retrieval import search

        return search(self.points(), vector, top_k=top_k, metric=self.metric, where=where)


__all__ = ["VectorIndex", "index_points", "upsert_frames", "dedup_last", "POINT", "INDEX_POINT_FIELDS"]
