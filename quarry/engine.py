"""From a configuration to answers: ingest with all limits, index, search."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config, IngestLimits, SearchLimits
from quarry.operators import chunking, index, ingest, search, store
from quarry.operators.chunking import strip, units16
from quarry.sources import filesystem

LONGEST_PREFIX, LONGEST_QUERY, SHORTEST_QUERY = 200, 500, 2


class RateLimited(RuntimeError):
    """Too many searches run and wait."""


class Metrics:
    """Counters and durations by name; no query text ever is a name."""

    def __init__(self, most: int = 200):
        self.most, self.counters, self.durations = most, Counter(), {}

    def add(self, name: str, value: float = 1) -> None:
        if name in self.counters or len(self.counters) < self.most:
            self.counters[name] += value

    def lasted(self, name: str, ms: float) -> None:
        if name in self.durations or len(self.durations) < self.most:
            n, total, longest = self.durations.get(name, (0, 0.0, 0.0))
            self.durations[name] = (n + 1, total + ms, max(longest, ms))


@dataclass
class Ingested:
    """Chunks with positions, and what became of the corpus on the way."""

    chunks: DataFrame
    report: dict = field(default_factory=dict)
    skips: dict[str, int] = field(default_factory=dict)
    limits: tuple[str, ...] = ()


def cut_bytes(text, most):
    """The longest beginning of a text that has at most `most` bytes and ends with a whole character."""
    raw = F.encode(text, "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(F.lit(0), most - drop).cast("int")).cast("string")) for drop in range(4)])


def ingest_corpus(docs: DataFrame, limits: IngestLimits = IngestLimits(), how: chunking.ChunkLimits = chunking.ChunkLimits(), skips: dict[str, int] | None = None) -> Ingested:
    """docs (id, format, text) -> chunks, under the limits in their order: documents, blank and repeated texts, bytes, chunks, memory.

    Each limit follows the serial order of ids.  Null texts couldn't be read.
    """
    tally, reached = Counter(skips or {}), set()
    docs = docs.select("id", "format", "text")
    if limits.max_documents is not None:
        if docs.limit(limits.max_documents + 1).count() > limits.max_documents:
            reached.add("documents")
        docs = ingest.first_documents(docs, limits.max_documents)
    docs = store.written(docs, "documents")
    tally["read_failed"] += docs.filter("text IS NULL").count()
    tally.update({r.reason: r["count"] for r in ingest.skip_tally(docs.filter("text IS NOT NULL"), 1 << 62).collect()})
    kept = ingest.distinct_texts(docs)
    if limits.max_total_bytes is not None:
        total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if total > limits.max_total_bytes:
            reached.add("total_bytes")
        kept = ingest.within_bytes(kept, limits.max_total_bytes).withColumn("text", cut_bytes(F.col("text"), F.col("kept_bytes"))).select("id", "format", "text")
    chunks = ingest.positions(store.written(chunking.chunk_corpus(kept, how), "chunks"))
    for name, most, apply in (("chunks", limits.max_chunks, ingest.within_chunks), ("memory", limits.max_memory_bytes, ingest.within_memory)):
        if most is not None:
            left = apply(chunks, most)
            if left.count() < chunks.count():
                reached.add(name)
            chunks = left.select(*chunks.columns)
    row = ingest.report(kept, chunks).first().asDict()
    return Ingested(chunks, row, {k: v for k, v in sorted(tally.items()) if v}, tuple(sorted(reached)))


class Engine:
    """One corpus and its index.  Searches before the first build say so; a failed rebuild leaves the last index in use."""

    def __init__(self, spark: SparkSession, search_limits: SearchLimits = SearchLimits(), ingest_limits: IngestLimits = IngestLimits(), chunk_limits: chunking.ChunkLimits = chunking.ChunkLimits(), timeout_ms: int | None = None, configured: bool = True):
        self.spark, self.limits, self.ingest_limits, self.chunk_limits, self.timeout_ms = spark, search_limits, ingest_limits, chunk_limits, timeout_ms
        self.configured, self.root, self.index, self.ingested = configured, None, None, None
        self.state, self.error, self.version = "idle", None, 0
        self.metrics = Metrics()
        self._running = threading.BoundedSemaphore(search_limits.max_concurrent)
        self._waiting = threading.BoundedSemaphore(search_limits.max_concurrent + search_limits.queue_limit)
        self.walk: dict[str, int] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config) -> Engine:
        """An engine for the configured source, not built yet."""
        out = cls(spark, config.search, config.ingest, config.chunk, config.search.timeout_ms, config.source != "none")
        out.root = config.root
        out.walk = {"max_depth": config["CORPUS_MAX_DEPTH"], "max_entries": config["CORPUS_MAX_DIRECTORY_ENTRIES"]}
        return out

    def build(self, docs: DataFrame | None = None) -> Engine:
        """Ingest and index docs (id, format, text), or else the configured folder."""
        self.state = "building"
        began = time.monotonic()
        try:
            skips: dict[str, int] = {}
            if docs is None:
                if self.root is None:
                    raise filesystem.CorpusUnavailable("no corpus is configured", "not_configured")
                listed = filesystem.listed(self.spark, self.root, self.ingest_limits.max_document_bytes, **self.walk).cache()
                skips = {r.reason: r["count"] for r in listed.filter("reason IS NOT NULL").groupBy("reason").count().collect()}
                docs = filesystem.documents(self.spark, self.root, listed.filter("reason IS NULL"), self.ingest_limits.max_document_bytes)
            ingested = ingest_corpus(docs, self.ingest_limits, self.chunk_limits, skips)
            built = index.build(ingested.chunks, self.ingest_limits.max_terms, self.version + 1)
        except Exception as bad:
            self.error, self.state = getattr(bad, "reason", type(bad).__name__), "degraded" if self.index else "failed"
            raise
        before = self.index
        self.ingested, self.index, self.version, self.error = ingested, built, self.version + 1, None
        self.state = "ready" if built.n else "ready_empty"
        if before is not None:
            before.release()
        self.metrics.lasted("index.build", 1000 * (time.monotonic() - began))
        return self

    def _corpus(self) -> dict:
        report = self.ingested.report if self.ingested else {}
        return {"index_version": self.version, "document_count": report.get("document_count", 0), "chunk_count": report.get("chunk_count", 0)}

    def _response(self, status: str, warnings: set[str], results: list[dict] = (), candidates: int = 0, truncated: bool = False) -> dict:
        characters = sum(units16(r["content"]) for r in results)
        self.metrics.add(f"search.{status}")
        reached = sorted({*(self.ingested.limits if self.ingested else ()), *(self.index.limits if self.index else ())})
        counts = {"candidates": candidates, "returned": len(results), "content_characters": characters, "approximate_tokens": -(-characters // 4)}
        return {"status": status, "results": list(results), "corpus": self._corpus(), "counts": counts, "truncated": truncated, "limits_reached": reached, "warnings": sorted(warnings)}

    def search(self, query: str, limit: int = 5, source_prefix: str | None = None) -> dict:
        """The response to one query: status, results, counts, warnings.  A query, limit or prefix out of bounds is a ValueError."""
        query = strip(query)
        if not SHORTEST_QUERY <= units16(query) <= LONGEST_QUERY:
            raise ValueError("a query has 2 to 500 characters")
        if not 1 <= limit <= self.limits.max_results:
            raise ValueError(f"limit lies in 1..{self.limits.max_results}")
        if source_prefix is not None and (len(source_prefix) > LONGEST_PREFIX or not re.fullmatch(r"[\w.\-/]*", source_prefix)):
            raise ValueError("a source prefix has letters, digits, dots, dashes and slashes only, 200 at most")
        if not self._waiting.acquire(blocking=False):
            raise RateLimited("too many searches are waiting")
        try:
            if not self._running.acquire(timeout=(self.timeout_ms or 30_000) / 1000):
                raise RateLimited("no search ended in time")
            try:
                return self._search(query, limit, source_prefix)
            finally:
                self._running.release()
        finally:
            self._waiting.release()

    def _search(self, query: str, limit: int, prefix: str | None) -> dict:
        if self.index is None:
            why = "index_not_configured" if not self.configured else "index_building" if self.state == "building" else "corpus_unreachable" if self.error else None
            return self._response("unavailable", {why} - {None})
        stale = self.state == "degraded"
        warnings = {w for w, holds in (("stale_index", stale), ("ingestion_limits_reached", bool(self.ingested.limits or self.index.limits))) if holds}
        if not self.index.n:
            return self._response("degraded" if stale else "no_match", warnings | {"corpus_empty"})
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        matches = self._collected(search.score(asked, self.index, self.limits, prefix or None).orderBy("rank"))
        if matches is None:
            return self._response("degraded", warnings | {"search_deadline_exceeded", "weak_evidence"})
        if not matches or matches[0]["score"] < self.limits.min_score:
            return self._response("degraded" if stale else "no_match", warnings | {"weak_evidence"}, candidates=len(matches))
        results, truncated, more = search.select(matches, limit, self.limits)
        return self._response("degraded" if stale else "ok", warnings | more, results, len(matches), truncated)

    def _collected(self, df: DataFrame) -> list[dict] | None:
        """The rows (of one query's candidates, a bounded number); None if the deadline came first and the job was broken off."""
        tag, late, done = f"quarry-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def stop() -> None:
            late.set()
            while not done.wait(0.05):  # jobs of the query that are yet to start count as well
                self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout_ms / 1000, stop) if self.timeout_ms else None
        self.spark.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            rows = [r.asDict() for r in df.collect()]
            return None if late.is_set() else rows
        except Exception:
            if late.is_set():
                return None
            raise
        finally:
            done.set()
            if timer:
                timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def search_batch(self, queries: DataFrame, limit: int = 5, source_prefix: str | None = None) -> DataFrame:
        """Results for every row of queries (query_id, query), in one plan."""
        if self.index is None:
            raise RuntimeError("the index isn't built")
        return search.select_results(search.score(queries, self.index, self.limits, source_prefix), limit, self.limits)
