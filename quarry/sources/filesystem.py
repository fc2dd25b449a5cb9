"""A folder tree as a corpus.

The driver walks the tree and looks at names and sizes; what is admitted is
decided by the policy's Column expressions; texts are read by the executors,
which must see the folder.  Corpora beyond one folder tree are tables and go
through `quarry.operators.ingest` directly.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import policy as P

#: Control bytes, of which a text file has few.
_CONTROL = bytes([*range(9), *range(14, 32)])
ENTRY = "path string, kind string, size_bytes long, modified_ms long"
DOCUMENT = "id string, format string, text string, size_bytes long, revision string, truncated boolean"


class CorpusUnavailable(Exception):
    """The root can't serve: reason is not_found or forbidden."""

    def __init__(self, message: str, reason: str):
        super().__init__(message)
        self.reason = reason


def canonical_root(root: str) -> str:
    """The root without links; an error if there is none, it can't be looked at, or it isn't a folder."""
    try:
        real = os.path.realpath(root, strict=True)
    except OSError as bad:
        raise CorpusUnavailable("the documentation root does not exist", "not_found") from bad
    try:
        found = os.stat(real)
        os.scandir(real).close()
    except NotADirectoryError:
        pass
    except OSError as bad:
        raise CorpusUnavailable("the documentation root can't be read", "forbidden") from bad
    if not stat.S_ISDIR(found.st_mode):
        raise CorpusUnavailable("the documentation root is not a folder", "not_found")
    return real


def entries(root: str, max_depth: int = 12, max_entries: int = 2_000) -> Iterator[tuple[str, str, int, int]]:
    """(path, kind, size, modified) below the root: kind is file, or why something else is left out.

    Folders are read in the order of their names and, beyond max_entries names,
    no further; links are never followed.
    """
    open_ = [("", 0)]
    while open_:
        folder, depth = open_.pop()
        if depth > max_depth:
            yield folder, "limit_depth", 0, 0
            continue
        try:
            names = sorted(os.listdir(os.path.join(root, folder)))
        except OSError:
            yield folder, "read_failed", 0, 0
            continue
        if len(names) > max_entries:
            yield folder, "limit_directory_entries", 0, 0
        below = []
        for name in names[:max_entries]:
            path = f"{folder}/{name}" if folder else name
            try:
                found = os.lstat(os.path.join(root, path))
            except OSError:
                yield path, "read_failed", 0, 0
                continue
            mode = found.st_mode
            if stat.S_ISDIR(mode):
                if name.startswith(".") or name in P.IGNORED_DIRECTORIES:
                    yield path, "ignored_path", 0, 0
                else:
                    below.append((path, depth + 1))
                continue
            kind = "symbolic_link" if stat.S_ISLNK(mode) else "file" if stat.S_ISREG(mode) else "ignored_path"
            yield path, kind, found.st_size, found.st_mtime_ns // 1_000_000
        open_ += reversed(below)


def listed(spark: SparkSession, root: str, max_document_bytes: int | None = None, max_depth: int = 12, max_entries: int = 2_000) -> DataFrame:
    """Every entry with its id, format and `reason`, which is null for the documents admitted."""
    found = spark.createDataFrame(list(entries(canonical_root(root), max_depth, max_entries)), ENTRY)
    name, ident = F.element_at(F.split("path", "/"), -1), P.normalized(F.col("path"))
    form = P.format_of(P.extension(ident))
    reason = (
        F.when(F.col("kind") != "file", F.col("kind"))
        .when(P.ignored_file(name), "ignored_path")
        .when(ident.isNull(), "unsafe_identifier")
        .when(form.isNull(), "unsupported_extension")
        .when(F.col("size_bytes") > F.lit(max_document_bytes if max_document_bytes is not None else (1 << 62)), "oversized")
        .when(F.col("size_bytes") == 0, "empty")
    )
    return found.withColumn("id", ident).withColumn("format", form).withColumn("reason", reason)


def decode(raw: bytes, truncated: bool) -> str | None:
    """Strict UTF-8; a cut may have hit a character, so up to three bytes of a cut text's end may go."""
    for drop in range(4 if truncated else 1):
        try:
            return raw[: len(raw) - drop].decode("utf-8")
        except UnicodeDecodeError:
            continue
    return None


def read_confined(root: str, ident: str, most: int) -> tuple[str, str, bool] | None:
    """(text, revision, truncated) of a regular file below the root; None for links on the way, binary or undecodable content."""
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        *folders, name = ident.split("/")
        if any(part in ("", ".", "..") for part in (*folders, name)):
            return None
        for part in folders:
            inner = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = inner
        with os.fdopen(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=at), "rb") as file:
            found = os.fstat(file.fileno())
            if not stat.S_ISREG(found.st_mode):
                return None
            raw = file.read(max(1, most))
    except OSError:
        return None
    finally:
        os.close(at)
    head = raw[: P.SNIFFED]
    if b"\0" in head or len(head) - len(head.translate(None, _CONTROL)) > P.MOST_CONTROL * len(head):
        return None
    truncated = found.st_size > len(raw)
    text = decode(raw, truncated)
    if text is None:
        return None
    return text, hashlib.sha256(b"%d:" % found.st_size + raw).hexdigest()[:16], truncated


def documents(spark: SparkSession, root: str, admitted: DataFrame, max_document_bytes: int | None = None) -> DataFrame:
    """The texts of the admitted entries (id, format, size_bytes); what can't be read has a null text."""
    base, most = canonical_root(root), max_document_bytes or (1 << 31) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("format", pa.string()), ("text", pa.string()), ("size_bytes", pa.int64()), ("revision", pa.string()), ("truncated", pa.bool_())])
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(a, 64).to_pylist():
                    text, revision, cut = read_confined(base, r["id"], most) or (None, None, False)
                    rows.append({"id": r["id"], "format": r["format"], "text": text, "size_bytes": r["size_bytes"], "revision": revision, "truncated": cut})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return admitted.select("id", "format", "size_bytes").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, DOCUMENT)
