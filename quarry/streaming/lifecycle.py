"""Index lifecycle: manifests, builds that swap versions, and refresh by a streaming trigger."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old revision) and (id, new revision) -> id, change: added, removed or changed."""
    a, b = old.toDF("id", "_old"), new.toDF("id", "_new")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).filter("change IS NOT NULL")


def manifest_digest(manifest: DataFrame) -> str:
    """One digest of all (id, revision) pairs, whatever their order: count and two sums of row hashes."""
    rows = manifest.toDF("id", "revision")
    n, a, b = rows.agg(F.count("*"), F.sum(F.xxhash64("id", "revision").cast("decimal(38,0)")), F.sum(F.xxhash64("revision", "id").cast("decimal(38,0)"))).first()
    return f"{n}:{a}:{b}"


@dataclass(frozen=True)
class Snapshot:
    """What is known of the index; never holds paths, queries or content."""

    state: str
    configured: bool
    version: int = 0
    document_count: int = 0
    chunk_count: int = 0
    term_count: int = 0
    limits_reached: tuple[str, ...] = ()
    last_outcome: str = "pending"
    last_error: str | None = None
    last_build_ms: float | None = None


class IndexManager:
    """Builds an index with `build`, swaps whole versions, keeps the last good one when a build fails.

    `probe` gives the corpus manifest's digest; a refresh that finds it as it
    was skips the build (and makes a degraded index ready again).
    """

    def __init__(self, build: Callable[[int], object] | None, probe: Callable[[], str] | None = None, describe: Callable[[object], dict] | None = None, on_event: Callable[[str, dict], None] | None = None):
        self._build, self._probe = build, probe
        self._describe = describe or (lambda index: {})
        self._on_event = on_event or (lambda kind, fields: None)
        self._lock, self._state = threading.Lock(), threading.Lock()
        self._index: object | None = None
        self._digest: str | None = None
        self._closed = False
        configured = build is not None
        self._snapshot = Snapshot("building" if configured else "failed", configured, last_error=None if configured else "not_configured")

    def snapshot(self) -> Snapshot:
        with self._state:
            return self._snapshot

    def current(self) -> object | None:
        with self._state:
            return self._index

    def usable(self) -> bool:
        return self.snapshot().state in ("ready", "ready_empty", "degraded")

    def refresh(self, reason: str = "manual") -> Snapshot:
        """One build at a time; returns the snapshot after it."""
        if self._build is None or self._closed:
            return self.snapshot()
        with self._lock:
            began = time.monotonic()
            try:
                digest = self._probe() if self._probe else None
                if reason != "startup" and digest is not None and digest == self._digest and self._index is not None:
                    with self._state:
                        back = "ready" if self._snapshot.chunk_count else "ready_empty"
                        self._snapshot = replace(self._snapshot, state=back, last_outcome="unchanged", last_error=None)
                    self._on_event("index.build.unchanged", {"reason": reason})
                    return self.snapshot()
                self._on_event("index.build.started", {"reason": reason})
                version = self._snapshot.version + 1
                built = self._build(version)
                known = self._describe(built)
                state = "ready" if known.get("chunk_count", 1) else "ready_empty"
                limits = tuple(sorted(known.get("limits_reached", ())))
                with self._state:
                    self._index, self._digest = built, digest
                    self._snapshot = Snapshot(state, True, version, known.get("document_count", 0), known.get("chunk_count", 0), known.get("term_count", 0), limits, "partial" if limits else "success", None, 1000 * (time.monotonic() - began))
                self._on_event("index.build.succeeded", {"version": version})
            except Exception as failure:  # the last good version stays
                code = getattr(failure, "reason", "build_failed")
                with self._state:
                    self._snapshot = replace(self._snapshot, state="degraded" if self._index is not None else "failed", last_outcome="failed", last_error=code)
                self._on_event("index.build.failed", {"code": code})
            return self.snapshot()

    def close(self) -> None:
        self._closed = True

    def watch(self, spark: SparkSession, every: str = "60 seconds", checkpoint: str | None = None):
        """A streaming query that refreshes at each trigger; file streams don't see edits, manifests do."""
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, number: self.refresh("interval"))
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.start()


def readiness(snapshot: Snapshot) -> tuple[str, str]:
    """(status, detail)."""
    if not snapshot.configured:
        return "not_ready", "no corpus is configured"
    if snapshot.state in ("ready", "ready_empty"):
        return "ready", "the index answers queries"
    if snapshot.state == "degraded":
        return "degraded", "the last good index answers; the latest refresh failed"
    return "not_ready", "the index is being built" if snapshot.state == "building" else "no index could be built"
