"""Edges of op3, op4 and op10."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quarry.llm import mixing, repair_tokens, warc
from quarry.llm.common import shared_dir, table


def test_warc_edges(spark):
    big = "x" * 150
    rows = [(5, "http://a\r\nb", big, "c"), (2, None, big, "c"), (None, "u", big, "c"), (7, "u", None, "c"), (8, "u", "", "c"), (9, "u", "é" * 60, "c"), (9, "u", "é" * 60, "c"), (10, "u", "small", "c"), (11, "u", "small", "c")]
    path = shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), path)
    got = warc.read_records(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        assert bytes(r.record) == r.header.encode() + bytes(r.payload) + b"\r\n\r\n" and r.header.endswith("\r\n\r\n")
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    want = [(5, "revisit", 2), (2, "response", None), (None, "revisit", 2), (7, "response", None), (8, "response", None), (9, "response", None), (9, "response", None), (10, "response", None), (11, "response", None)]
    assert kinds == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    empty = shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, empty).collect() == []


def water(sizes, weights, share, cap):
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets(spark):
    sources = {"a": 100, "B": 3000, "c": 50, None: 4000, "é": 20}
    rows = [(i, "w " * 10, s, 1) for s, n in sources.items() for i in range(n // 10)] + [(None, None, "a", 1), (3, "", "zero", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").drop("target")
    got = mixing.mix(df).collect()
    sizes = sources | {"zero": 0}
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water({s: n for s, n in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 10 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).collect() == []
    copies = mixing.repeated(df)
    assert copies.columns == df.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in copies.collect())
    assert words == sum(taken.values())


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 5000):
        ids = rng.integers(0, 4, n * 3).astype(np.uint32)
        ids[: n // 2] = 7
        ends = np.unique(np.append(rng.integers(1, ids.size + 1, 5), ids.size))
        shard = repair_tokens.Shard(repair_tokens.pack(ids, ends, 50_257))
        assert (shard.decode() == ids).all()
        begins = np.concatenate([[0], ends[:-1]])
        assert (shard.document_lengths() == ends - begins).all()
        for i in range(len(ends)):
            assert (shard.decode(i) == ids[begins[i] : ends[i]]).all()


@pytest.mark.parametrize("shard_ids", [1 << 19, 300])
def test_tokens_match_the_library(spark, sf, shard_ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text, "x") for r in table(spark, sf, "documents").limit(60).collect()] + [(10**9, None, "x"), (10**9 + 1, "", "x"), (10**9 + 2, "a  b\n \n<|endoftext|> it's 　x ", "x")]
    got = sorted(map(tuple, repair_tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, start string"), shard_ids=shard_ids).collect()))
    start, want = 0, []
    for doc_id, text, _ in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_tokens_empty(spark):
    assert repair_tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_mix_with_columns_of_its_own_names(spark):
    """Extra columns keep their values whatever they are called."""
    rows = [(i, "a b c d e", f"s{i % 3}", 7 * i, "t", -1, "w") for i in range(60)]
    names = ["doc_id", "text", "source", "size", "target", "taken", "source_size"]
    docs = spark.createDataFrame(rows, names)
    out = mixing.repeated(docs)
    assert out.columns == names
    assert {tuple(r)[2:] for r in out.collect()} <= {r[2:] for r in rows}
    assert out.count() > 0 and mixing.repeated(docs.limit(0)).collect() == []
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", *mixing.ADDED]
