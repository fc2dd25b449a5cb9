"""A folder tree from files to answers."""

import os

import pytest

from quarry.config import ChunkLimits, IngestLimits, SearchLimits, build_config
from quarry.engine import Engine, ingest_corpus
from quarry.sources import filesystem


def tree(root):
    files = {
        "guide/login.md": "# Signing in\n\nTokens expire after an hour.\n\n## Renewal\n\nCall the renew endpoint with the refresh token to sign in again.\n",
        "guide/copy.md": "# Signing in\n\nTokens expire after an hour.\n\n## Renewal\n\nCall the renew endpoint with the refresh token to sign in again.\n",
        "setup.txt": "Install the package, then start the server on port eight thousand.\n\nLogs rotate every night.",
        "page.html": "<h1>Glossary</h1><p>A shard is a part of an index.</p>",
        "node_modules/x.md": "never", ".hidden.md": "never", "secret.txt": "never", "empty.md": "", "image.png": "no", "big.txt": "x" * 5000,
        "a/b/c/d.md": "too deep",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bin.txt").write_bytes(b"a\0b")
    (root / "bad.txt").write_bytes(b"caf\xe9 and more")
    os.symlink(root / "setup.txt", root / "link.txt")
    os.symlink(root / "guide", root / "linked")


def test_tree(spark, tmp_path):
    tree(tmp_path)
    env = {"DOCS_ROOT": str(tmp_path), "CORPUS_MAX_DEPTH": "2", "CORPUS_MAX_DOCUMENT_BYTES": "4096", "SEARCH_TIMEOUT_MS": "30000"}
    engine = Engine.from_config(spark, build_config(env))
    assert engine.search("refresh token")["status"] == "unavailable"
    engine.build()
    assert engine.ingested.skips == {"duplicate_content": 1, "empty": 1, "ignored_path": 3, "limit_depth": 1, "oversized": 1, "read_failed": 2, "symbolic_link": 2, "unsupported_extension": 1}
    assert engine.ingested.report["document_count"] == 3
    engine.timeout_ms = None
    got = engine.search("renew the refresh token")
    assert got["status"] == "ok" and got["results"][0]["source"] == "guide/copy.md" and got["results"][0]["section_path"][0] == "Signing in"
    assert got["counts"]["returned"] == len(got["results"]) and got["corpus"]["index_version"] == 1
    none = engine.search("zebra quagga")
    assert none["status"] == "no_match" and none["warnings"] == ["weak_evidence"] and none["results"] == []
    assert engine.search("refresh token", source_prefix="setup")["status"] == "no_match"
    asked = spark.createDataFrame([("a", "rotate logs"), ("b", "shard of an index")], "query_id string, query string")
    assert {r.query_id: r.source for r in engine.search_batch(asked, 1).collect()} == {"a": "setup.txt", "b": "page.html"}
    for bad in ({"query": "x"}, {"query": "y" * 501}, {"query": "fine", "limit": 0}, {"query": "fine", "source_prefix": "a b"}):
        with pytest.raises(ValueError):
            engine.search(**bad)
    engine.root = str(tmp_path / "gone")
    with pytest.raises(filesystem.CorpusUnavailable):
        engine.build()
    late = engine.search("renew the refresh token")
    assert late["status"] == "degraded" and "stale_index" in late["warnings"] and late["results"]
    engine.timeout_ms = 1
    assert "search_deadline_exceeded" in engine.search("renew the refresh token")["warnings"]


def test_reading(tmp_path):
    tree(tmp_path)
    root = filesystem.canonical_root(str(tmp_path))
    assert filesystem.read_confined(root, "setup.txt", 7)[0] == "Install"
    assert filesystem.read_confined(root, "../x", 7) is None and filesystem.read_confined(root, "linked/login.md", 99) is None
    (tmp_path / "é.txt").write_text("ab€")
    assert filesystem.read_confined(root, "é.txt", 4)[::2] == ("ab", True)
    with pytest.raises(filesystem.CorpusUnavailable) as bad:
        filesystem.canonical_root(str(tmp_path / "setup.txt"))
    assert bad.value.reason == "not_found"


def test_limits(spark):
    docs = spark.createDataFrame([(f"d{i}.txt", "text", f"{i} " + "word " * 40 + "é") for i in range(9)] + [("x.txt", "text", None), ("y.txt", "text", " ")], "id string, format string, text string")
    got = ingest_corpus(docs, IngestLimits(max_documents=8, max_total_bytes=1000, max_chunks=4), ChunkLimits())
    assert got.limits == ("chunks", "documents", "total_bytes") and got.chunks.count() == 4
    every = ingest_corpus(docs)
    assert every.limits == () and every.skips == {"empty": 1, "read_failed": 1} and every.chunks.count() == 9
    empty = Engine(spark, SearchLimits()).build(docs.limit(0))
    assert empty.search("anything")["warnings"] == ["corpus_empty"]
