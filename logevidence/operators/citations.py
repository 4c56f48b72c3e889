"""D-05..D-07: evidence blocks, ``[E#]`` expansion and citation validation.

The model-facing side (prompting, generation) is not built; what is built is the
deterministic table work around it: label retrieved chunks ``E1..Ek``, expand
markers in answer texts to real citations and validate them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ABSTENTION_SENTENCE
from ..functions.events import severities_text

MARKER = r"\[E([0-9]+)\]"
SENTENCE_END = "[.!?]+"
LETTER = r"\p{L}"


def evidence_blocks(results: DataFrame) -> DataFrame:
    """D-05: ``evidence_id`` (E<rank>), a two-line metadata header and the chunk text, per result row."""
    by = [c for c in ("query_id",) if c in results.columns]
    header = F.concat(
        F.lit("["), F.concat(F.lit("E"), F.col("rank").cast("string")), F.lit("] (score "),
        F.format_string("%.2f", F.col("score")), F.lit(") origen="), F.col("source_file"),
        F.lit(" líneas="), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"),
        F.lit("\n     ts="), F.coalesce(F.col("ts_start"), F.lit("-")), F.lit(".."), F.coalesce(F.col("ts_end"), F.lit("-")),
        F.lit(" severidades="), severities_text(F.col("severities"), ":", ",", "-"),
    )
    return results.select(
        *by, F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"), "rank", "chunk_id",
        header.alias("header"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.concat(header, F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))).alias("block"),
    )


def evidence_text(results: DataFrame) -> DataFrame:
    """D-05: all evidence of a query (k blocks) as one text, blocks apart by a line of dashes."""
    blocks = evidence_blocks(results)
    by = [c for c in ("query_id",) if c in blocks.columns]
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n---\n").alias("evidence"))


def answer_metrics(validated: DataFrame) -> DataFrame:
    """Over all answers of :func:`validate_answers`: valid share of the markers, cited share of the factual
    sentences (abstentions have none to cite), and share of answers that don't pass."""
    factual = F.when(F.col("is_abstention"), 0).otherwise(F.col("n_sentences"))
    return validated.agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.round(F.try_divide(F.sum("n_valid"), F.sum("n_markers")), 4).alias("marker_validity"),
        F.round(F.try_divide(F.sum(factual - F.col("n_uncited")), F.sum(factual)), 4).alias("grounding"),
        F.round(F.avg(F.when(F.col("passes"), 0.0).otherwise(1.0)), 4).alias("unverified_share"),
    )


def expanded_citation(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per evidence: ``[E#] file:Lx-Ly · ts_start → ts_end · sev×n, ...``."""
    sev = F.array_join(
        F.transform(F.map_entries("severities"), lambda e: F.concat(e["key"], F.lit("×"), e["value"].cast("string"))),
        ", ",
    )
    txt = F.concat(
        F.lit("[E"), F.col("rank").cast("string"), F.lit("] "), F.col("source_file"), F.lit(":L"),
        F.col("line_start").cast("string"), F.lit("-L"), F.col("line_end").cast("string"), F.lit(" · "),
        F.coalesce(F.col("ts_start"), F.lit("-")), F.lit(" → "), F.coalesce(F.col("ts_end"), F.lit("-")), F.lit(" · "),
        F.when(F.size("severities") > 0, sev).otherwise(F.lit("-")),
    )
    return results.select(*by, F.col("rank").cast("long").alias("marker_no"), txt.alias("expanded"))


def expand_markers(answers: DataFrame, results: DataFrame, text_col: str = "answer") -> DataFrame:
    """D-06: one row per ``[E#]`` marker of each answer, with its expansion (null if unknown).

    A number beyond any evidence, however long, is unknown.
    """
    keys = [c for c in answers.columns if c != text_col]
    marks = answers.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(MARKER), 1)).alias(
        "marker_pos", "num"))
    marks = marks.withColumn("marker_no", F.col("num").try_cast("long"))
    # With a query_id on both sides each answer has its own evidence.
    by = [c for c in ("query_id",) if c in keys and c in results.columns]
    out = marks.join(expanded_citation(results, by), on=[*by, "marker_no"], how="left")
    return out.select(*keys, (F.col("marker_pos") + 1).alias("marker_pos"),
                      F.concat(F.lit("[E"), F.col("num"), F.lit("]")).alias("marker"),
                      "expanded", F.col("expanded").isNotNull().alias("is_known"))


def validate_answers(answers: DataFrame, n_evidence: int, text_col: str = "answer") -> DataFrame:
    """D-07: per answer, marker validity, abstention and uncited factual sentences.

    A sentence is a piece between runs of ``.!?``; it is factual when it has a
    letter and cited when it holds a marker. An answer passes when every marker
    exists and either it is exactly the abstention sentence or it cites at least
    once and has no uncited factual sentence.
    """
    keys = [c for c in answers.columns if c != text_col]
    t = F.col(text_col)
    nums = F.transform(F.regexp_extract_all(t, F.lit(MARKER), 1), lambda x: x.try_cast("int"))
    n_mark = F.size(nums)
    n_valid = F.size(F.filter(nums, lambda x: F.coalesce((x >= 1) & (x <= n_evidence), F.lit(False))))
    pieces = F.filter(F.split(t, SENTENCE_END, -1), lambda p: F.trim(p) != "")
    factual = F.filter(pieces, lambda p: p.rlike(LETTER))
    uncited = F.size(F.filter(factual, lambda p: ~p.rlike(MARKER)))
    abst = F.trim(t) == F.lit(ABSTENTION_SENTENCE)
    x = answers.select(
        *keys,
        n_mark.alias("n_markers"),
        n_valid.alias("n_valid"),
        (n_mark - n_valid).alias("n_unknown"),
        abst.alias("is_abstention"),
        F.size(factual).alias("n_sentences"),
        F.when(abst, F.lit(0)).otherwise(uncited).alias("n_uncited"),
    )
    return x.withColumn(
        "valid_share", F.when(F.col("n_markers") > 0, F.round(F.col("n_valid") / F.col("n_markers"), 4))
    ).withColumn(
        "passes",
        (F.col("n_unknown") == 0) & (F.col("is_abstention") | ((F.col("n_markers") > 0) & (F.col("n_uncited") == 0))),
    )
