import hashlib
import random
from collections import Counter

import pytest

from quarry.llm import repeats
from quarry.llm.common import table


def brute(texts, depth=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + depth] for x in raw for i in range(len(x) - depth + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - depth + 1):
            if seen[x[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=3):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefghij klmnoé") for _ in range(n))

    passage, line, base = prose(300), prose(150), prose(900)
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, passage[:199], prose(199)]
    texts += [prose(rng.randint(0, 300)) + passage + prose(rng.randint(0, 300)) for _ in range(40)]
    texts += [prose(50) + line + "\n" + prose(150) for _ in range(40)]
    for _ in range(30):
        i = rng.randrange(900)
        texts.append(base[:i] + prose(3) + base[i + 3 :])
    texts += [base] * 3 + [prose(400) + base[100:420] + base[80:400]]
    texts += [prose(1500) for _ in range(10)]
    return texts


@pytest.mark.parametrize("split_above,block,how", [(256, 4 << 20, {}), (3, 1 << 9, {}), (3, 1 << 9, {"chunk": 2}), (3, 1 << 9, {"chunk": 2, "most_open": 0})])
def test_planted(spark, monkeypatch, split_above, block, how):
    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = planted()
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_bytes string").repartition(3)
    got = Counter(tuple(r) for r in repeats.repeated_windows(df, split_above=split_above, **how).drop("spans").collect())
    assert got == Counter((i, *x) for i, x in zip(ids, brute(texts), strict=True))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").collect()
    want = sorted((d.doc_id, *x) for d, x in zip(docs, brute([d.text for d in docs]), strict=True))
    assert sorted(map(tuple, repeats.query(spark, sf).collect())) == want


def test_empty(spark):
    assert repeats.repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
