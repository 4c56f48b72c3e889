"""Job parameters, their defaults and the preconditions every job enforces."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the original tool's for identical results.
# Default IIS W3C column list, used when a file carries no "#Fields:" line or
# when headers are ignored:
DEFAULT_IIS_FIELDS = (
    "date",
    "time",
    "s-ip",
    "cs-method",
    "cs-uri-stem",
    "cs-uri-query",
    "s-port",
    "cs-username",
    "c-ip",
    "cs(User-Agent)",
    "sc-status",
    "sc-substatus",
    "sc-win32-status",
    "time-taken",
)
# English month abbreviations of the HAProxy accept date, in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# Every zone label, known or not, is rendered with this offset suffix.
TZ_SUFFIX = "+00:00"
# Sentence an answer must contain, verbatim, to count as an abstention.
ABSTENTION_SENTENCE = "No hay evidencia suficiente en los logs para responder esa pregunta."
# Relevance label weights of the retrieval evaluation.
RELEVANCE_WEIGHTS = {"R": 1.0, "P": 0.5, "N": 0.0}
# ---------------------------------------------------------------------------

SOURCES = ("auto", "haproxy", "iis")
ERROR_POLICIES = ("skip", "keep", "fail")
METRICS = ("cosine", "l2", "ip")


@dataclass(frozen=True)
class Params:
    """All tunables with the original defaults. Validate with :meth:`check`."""

    file_patterns: tuple[str, ...] = ("*.log",)
    file_pattern: str = "*.log"
    recursive: bool = False
    encoding: str = "utf-8"
    source_type: str = "auto"
    iis_fields_from_header: bool = True
    iis_fields: tuple[str, ...] = DEFAULT_IIS_FIELDS
    on_parse_error: str = "skip"
    timezone: str = "UTC"
    chunk_size: int = 20
    chunk_overlap: int = 4
    embedding_model: str = "hash-md5-384"  # name recorded with the default hash encoder's vectors
    embedding_dim: int = 384
    embedding_batch_size: int = 32
    similarity_metric: str = "cosine"
    collection_name: str = "logevidence"
    top_k: int = 5
    score_threshold: float = 0.0

    def effective_patterns(self) -> tuple[str, ...]:
        """S-02: a non-empty list wins, else the single legacy pattern."""
        return tuple(self.file_patterns) if self.file_patterns else (self.file_pattern,)

    def check(self) -> "Params":
        check_source(self.source_type)
        check_policy(self.on_parse_error)
        check_chunking(self.chunk_size, self.chunk_overlap)
        if self.embedding_batch_size <= 0:
            raise ValueError(f"embedding_batch_size must be > 0, got {self.embedding_batch_size}")
        check_metric(self.similarity_metric)
        check_top_k(self.top_k)
        check_threshold(self.score_threshold)
        return self


def check_source(source: str) -> str:
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}, got {source!r}")
    return source


def check_policy(policy: str) -> str:
    if policy not in ERROR_POLICIES:
        raise ValueError(f"on_parse_error must be one of {ERROR_POLICIES}, got {policy!r}")
    return policy


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk_size must be > 0, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"chunk_overlap must satisfy 0 <= overlap < chunk_size (overlap={overlap}, size={size})")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"similarity_metric must be one of {METRICS}, got {metric!r}")
    return metric


def check_top_k(top_k: int) -> int:
    if top_k <= 0:
        raise ValueError(f"top_k must be > 0, got {top_k}")
    return top_k


def check_threshold(t: float) -> float:
    if not 0.0 <= t <= 1.0:
        raise ValueError(f"score_threshold must be within [0, 1], got {t}")
    return t
