import hashlib
import re

import pytest

from quarry.llm import decontaminate
from quarry.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    """Windows as tuples of words in a dict."""
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.flag(d, b, keep=["doc_id"], **how).collect()
    out = []
    for r in rows:
        ids = ",".join(r.item_ids)
        out.append((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(ids.encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words))
    return sorted(out, key=repr)


DOCS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, None), (3, ""), (4, "...  !!"), (5, "un été très-chaud, 3.14 été"), (5, "un été très-chaud, 3.14 été"), (None, "solo"),
    (7, "x " * 5000 + "one two three four five six seven eight nine ten eleven twelve thirteen" + " y" * 300), (8, "three four"), (9, "a a a a a a"),
]
ITEMS = [(10, DOCS[0][1]), (9, "été très"), (11, None), (12, ""), (13, "Solo"), (None, "four"), (14, "three four"), (15, "a a a"), (10, "a a a")]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_edges_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "_blocks", lambda b, w, f=decontaminate._blocks: f(b, w, most))
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_suffix_arrays_in_small_parts(spark, monkeypatch):
    """A long text's words are cut into parts; matches over the cuts are found."""
    import numpy as np

    words = [f"w{i % 29}" for i in range(400)]
    hashes, _, _, text = decontaminate.by_text(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    block = decontaminate.Windows([(1, " ".join(words[40:70])), (2, "w3 w4"), (3, "w4 w3"), (4, "w28")])
    items = [words[40:70], ["w3", "w4"], ["w4", "w3"], ["w28"]]
    want = set()
    for w in items:
        size = min(13, len(w))
        own = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        want |= {i + j for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in own for j in range(size)}
    for most in (1, 7, 50, 1000):
        mask, _, item = decontaminate.Shard(hashes, text, 13, most).matches(block)
        assert set(np.flatnonzero(mask).tolist()) == want and sorted(item.tolist()) == [0, 1, 3]
        array = decontaminate.SuffixArray(hashes, text, 13)
        number = {h: i for i, h in enumerate(array.vocabulary.tolist())}
        coded = [[number[hashes[i + k]] for k in range(len(words[i : i + 13]))] for i in array.order.tolist()]
        assert coded == sorted(coded) and len(coded) == 400


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = sorted(map(tuple, decontaminate.query(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)
    assert got == brute(docs, items)


def test_removal_keeps_columns(spark):
    docs = spark.createDataFrame([(1, DOCS[0][1], "a", 7), (2, "clean words only", "b", 8)], "doc_id long, text string, n_hit string, item_ids int")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.remove(docs, bench).collect()] == [(2, "clean words only", "b", 8)]


def test_longest_matches(spark):
    words = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, "zz " + words + " end")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "start " + words)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(d, b).collect()] == [(1, "3", 1, 1, 40)]
