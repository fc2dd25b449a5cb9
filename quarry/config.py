"""Bounded configuration: defaults, ranges, and reading from an environment mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Key -> (least, most, default).
RANGES: dict[str, tuple[float, float, float]] = {
    "CORPUS_REFRESH_INTERVAL_MS": (0, 86_400_000, 0),
    "CORPUS_MAX_DEPTH": (1, 32, 12),
    "CORPUS_MAX_DIRECTORY_ENTRIES": (1, 50_000, 2_000),
    "CORPUS_MAX_DOCUMENTS": (1, 50_000, 2_000),
    "CORPUS_MAX_DOCUMENT_BYTES": (1_024, 16_777_216, 1_048_576),
    "CORPUS_MAX_TOTAL_BYTES": (1_024, 268_435_456, 33_554_432),
    "CORPUS_MAX_CONCURRENT_READS": (1, 32, 4),
    "INDEX_MAX_CHUNKS": (1, 500_000, 20_000),
    "INDEX_MAX_TERMS": (1_000, 5_000_000, 200_000),
    "INDEX_MAX_MEMORY_BYTES": (1_048_576, 1_073_741_824, 134_217_728),
    "INDEX_BUILD_TIMEOUT_MS": (1_000, 600_000, 60_000),
    "CHUNK_MAX_CHARS": (200, 8_000, 1_600),
    "CHUNK_MIN_CHARS": (0, 4_000, 160),
    "SECTION_MAX_CHARS": (16, 512, 200),
    "SEARCH_MIN_SCORE": (0, 1, 0.2),
    "SEARCH_RELATIVE_CUTOFF": (0, 1, 0.2),
    "SEARCH_MAX_CANDIDATES": (1, 10_000, 200),
    "SEARCH_MAX_RESULTS": (1, 25, 10),
    "SEARCH_MAX_PER_SOURCE": (1, 25, 3),
    "SEARCH_MAX_CONTENT_CHARS": (200, 8_000, 1_600),
    "SEARCH_MAX_TOTAL_CHARS": (200, 64_000, 8_000),
    "SEARCH_TIMEOUT_MS": (50, 30_000, 2_000),
    "SEARCH_MAX_CONCURRENT": (1, 64, 4),
    "SEARCH_QUEUE_LIMIT": (0, 1_000, 32),
}
_FRACTIONS = {"SEARCH_MIN_SCORE", "SEARCH_RELATIVE_CUTOFF"}
_TRUE, _FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


class ConfigurationError(ValueError):
    """A setting is out of its range or contradicts another."""


@dataclass(frozen=True)
class ChunkLimits:
    max_chars: int = 1_600
    min_chars: int = 160
    section_max_chars: int = 200


@dataclass(frozen=True)
class IngestLimits:
    """None lifts a limit; large corpora are built without any."""

    max_documents: int | None = None
    max_document_bytes: int | None = None
    max_total_bytes: int | None = None
    max_chunks: int | None = None
    max_memory_bytes: int | None = None
    max_terms: int | None = None


@dataclass(frozen=True)
class SearchLimits:
    algorithm: str = "bm25"
    min_score: float = 0.2
    relative_cutoff: float = 0.2
    #: None: every matching chunk.
    max_candidates: int | None = 200
    max_results: int = 10
    max_per_source: int = 3
    max_content_chars: int = 1_600
    max_total_chars: int = 8_000
    timeout_ms: int = 2_000
    max_concurrent: int = 4
    queue_limit: int = 32


@dataclass(frozen=True)
class Config:
    source: str = "none"
    root: str | None = None
    watch: bool = True
    values: Mapping[str, float] = field(default_factory=dict)

    def __getitem__(self, key: str) -> float:
        return self.values[key]

    @property
    def chunk(self) -> ChunkLimits:
        v = self.values
        return ChunkLimits(v["CHUNK_MAX_CHARS"], v["CHUNK_MIN_CHARS"], v["SECTION_MAX_CHARS"])

    @property
    def ingest(self) -> IngestLimits:
        v = self.values
        return IngestLimits(v["CORPUS_MAX_DOCUMENTS"], v["CORPUS_MAX_DOCUMENT_BYTES"], v["CORPUS_MAX_TOTAL_BYTES"], v["INDEX_MAX_CHUNKS"], v["INDEX_MAX_MEMORY_BYTES"], v["INDEX_MAX_TERMS"])

    @property
    def search(self) -> SearchLimits:
        v = self.values
        names = ("MIN_SCORE", "RELATIVE_CUTOFF", "MAX_CANDIDATES", "MAX_RESULTS", "MAX_PER_SOURCE", "MAX_CONTENT_CHARS", "MAX_TOTAL_CHARS", "TIMEOUT_MS", "MAX_CONCURRENT", "QUEUE_LIMIT")
        return SearchLimits(v["SEARCH_ALGORITHM"], *(v[f"SEARCH_{n}"] for n in names))


def build_config(env: Mapping[str, str] | None = None) -> Config:
    """Read settings; blank values count as unset, and anything out of range is refused."""
    given = {k: v.strip() for k, v in (os.environ if env is None else env).items() if v.strip()}
    values: dict = {}
    for key, (least, most, default) in RANGES.items():
        try:
            value = float(given[key]) if key in given else default
        except ValueError as bad:
            raise ConfigurationError(f"{key} is not a number") from bad
        if not least <= value <= most or key not in _FRACTIONS and value != int(value):
            raise ConfigurationError(f"{key} must lie in {least}..{most}")
        values[key] = float(value) if key in _FRACTIONS else int(value)
    if values["CHUNK_MIN_CHARS"] >= values["CHUNK_MAX_CHARS"]:
        raise ConfigurationError("CHUNK_MIN_CHARS must be below CHUNK_MAX_CHARS")
    algorithm = given.get("SEARCH_ALGORITHM", "bm25")
    if algorithm not in ("bm25", "tfidf"):
        raise ConfigurationError("SEARCH_ALGORITHM must be bm25 or tfidf")
    values["SEARCH_ALGORITHM"] = algorithm
    root = given.get("DOCS_ROOT")
    source = given.get("CORPUS_SOURCE", "filesystem" if root else "none")
    if source not in ("filesystem", "none"):
        raise ConfigurationError("CORPUS_SOURCE must be filesystem or none")
    if source == "filesystem" and not root:
        raise ConfigurationError("DOCS_ROOT is needed for a filesystem corpus")
    watch = given.get("CORPUS_WATCH", "true").lower()
    if watch not in _TRUE | _FALSE:
        raise ConfigurationError("CORPUS_WATCH must be a boolean")
    return Config(source, root, watch in _TRUE, values)
