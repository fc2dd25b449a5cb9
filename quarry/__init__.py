"""Quarry: a lexical retrieval engine and corpus toolkit expressed as Spark plans."""

from quarry.config import Config, ConfigurationError, IngestLimits, SearchLimits, build_config
from quarry.engine import Engine, RateLimited, ingest_corpus
from quarry.sources.filesystem import CorpusUnavailable

__version__ = "0.2.0"
__all__ = ["Config", "ConfigurationError", "CorpusUnavailable", "Engine", "IngestLimits", "RateLimited", "SearchLimits", "build_config", "ingest_corpus"]
