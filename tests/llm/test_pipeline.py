"""Every stage of the pipeline on what the one before kept, against plain Python."""

import warnings
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_decontaminate import brute
from test_simhash import classes, slow_fingerprint
from tokenizers import Tokenizer

from quarry.llm import toxicity
from quarry.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_python(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "tokens" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    every = table(spark, SF, "documents").collect()
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = model.scorer()
    assert sorted(kept["toxicity"]) == sorted(r for r in every if score((r.text or "").encode()) < 0.3)
    rows = kept["toxicity"]
    component = classes([slow_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(kept["near_duplicates"]) == sorted(r for r, c in zip(rows, component, strict=True) if r.doc_id == c)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in brute([(r.doc_id, r.text) for r in kept["near_duplicates"]], items) if x[-1]}
    assert bad and sorted(kept["contamination"]) == sorted(r for r in kept["near_duplicates"] if r.doc_id not in bad)
    size, mixed = defaultdict(int), defaultdict(int)
    for r in kept["contamination"]:
        size[r.source] += len((r.text or "").split())
    for r in kept["mixing"]:
        mixed[r.source] += len((r.text or "").split())
    assert set(mixed) <= set(size) and all(mixed[s] <= 2 * size[s] + 5 for s in size)
    assert abs(sum(mixed.values()) - 1.5 * sum(size.values())) < 0.01 * sum(size.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept["mixing"])
    assert Counter((r.doc_id, r.n_tokens) for r in kept["tokens"]) == want
    assert sum(r.n_tokens for r in kept["tokens"]) == max(r.start + r.n_tokens for r in kept["tokens"])


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names, and no rows."""
    rows = [(1, None, None, 1, "a"), (2, "", "s", 2, "b"), (None, "some words without an id", None, 3, "c"), (3, "long " * 60_000, "s", 4, "d"), (3, "long " * 60_000, "s", 4, "d"), (4, "plain text of a few words", "t", None, None), (5, "plain text of a few words", "t", 5, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long, component_id string")
    for n, docs in enumerate((odd, odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "tokens" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            if name == "near_duplicates" and not n:
                left = docs.collect()
                assert sorted((r.doc_id or 0, r.taken or 0) for r in left) == [(0, 3), (1, 1), (3, 4), (4, 0)]
        assert n or docs.count() >= 4
        assert not n or docs.count() == 0
