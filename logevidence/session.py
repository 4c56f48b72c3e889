"""Session helpers: settings the jobs rely on and the shared scratch folder."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job assumes. Timestamps are labelled, never shifted, so the
# session zone must be UTC; AQE re-plans joins against measured sizes.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles that feed CPU-heavy work (chunk building, encoding) keep
    # several tasks; large shuffles are unaffected (far above this per task).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python worker holds at a time: chunk texts and vectors are wide rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "logevidence") -> SparkSession:
    """Local session for tests, benches and examples (UI off, no ports served)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LOGEVIDENCE_DRIVER_MEMORY", "8g"))
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable job settings to an existing session and make
    the package importable by the Python workers."""
    for k, v in JOB_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static confs cannot change at runtime
            pass
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of this package once per SparkContext (the usual
    ``--py-files`` route), so Arrow/pandas functions resolve on every executor.

    The zip is written under the shared ``spark.checkpoint.dir`` through the
    Hadoop FileSystem API, so executors fetch it from shared storage.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = shared_dir(spark, "pyfiles") + "/logevidence.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is only read here. When
    it is unset (local tests) a private folder is created and registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="logevidence-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # not settable at runtime on some deployments
            pass
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
