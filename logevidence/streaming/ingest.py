"""Continuous ingestion of a log folder with Structured Streaming.

The original tool is batch only; this runs the same batch jobs on every
micro-batch of newly arrived files. A file source hands each file to exactly
one micro-batch, whole, so per-file line numbers, IIS header carry-forward and
chunk windows computed inside ``foreachBatch`` are exact. Outputs are written to
``batch=<id>`` folders with overwrite, so a retried micro-batch replaces its own
output (exactly-once together with the checkpoint). Under ``fail`` an unparseable
line ends the stream. Lines appended to a file that was already taken are not
read: files must arrive whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Params
from ..operators.chunking import chunk_events
from ..operators.parse import ParseError, classify_lines, events_of, first_error
from ..session import apply_job_conf, shared_dir
from ..sources.files import LINE_FEED, _brace, check_hidden_files, number_lines


def start_ingest(spark: SparkSession, logs_dir: str, out_dir: str, params: Params = Params(), *,
                 checkpoint: str | None = None, forced_source: str | None = None,
                 max_files_per_trigger: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Stream new files of ``logs_dir`` into ``out_dir/events`` and ``out_dir/chunks``."""
    apply_job_conf(spark)
    params.check()
    check_hidden_files(spark, logs_dir, params.effective_patterns(), params.recursive)
    reader = (
        spark.readStream.format("text")
        .option("lineSep", LINE_FEED)
        .option("pathGlobFilter", _brace(params.effective_patterns()))
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
    )
    if params.recursive:
        reader = reader.option("recursiveFileLookup", "true")
    stream = reader.load(logs_dir).select("value", "_metadata")
    policy = "keep" if params.on_parse_error == "keep" else "skip"

    def process(batch: DataFrame, batch_id: int) -> None:
        lines = number_lines(batch, params.encoding)
        cl = classify_lines(lines, forced_source=forced_source, source_type=params.source_type,
                            iis_fields=params.iis_fields, iis_fields_from_header=params.iis_fields_from_header)
        if params.on_parse_error == "fail":
            bad = first_error(cl)
            if bad is not None:
                raise ParseError(f"unparseable line in {bad['source_file']}:{bad['line_number']} -> {bad['raw']!r}")
        ev_path = f"{out_dir}/events/batch={batch_id}"
        events_of(cl, policy).write.mode("overwrite").parquet(ev_path)
        ev = batch.sparkSession.read.parquet(ev_path)
        chunk_events(ev, params.chunk_size, params.chunk_overlap).write.mode("overwrite").parquet(
            f"{out_dir}/chunks/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(process).option(
        "checkpointLocation", checkpoint or shared_dir(spark, "ingest-checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
