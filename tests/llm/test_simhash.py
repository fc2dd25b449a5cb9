import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import table


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    """component ids by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprints():
    for text in ["", " \t\n", "One", "a b c", "a b c d", "A  b\nc d E", "é Ü ß x y z " * 50, "w " * 40000, "　a　b c d e f"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").collect()
    fps = [slow_fingerprint(d.text) for d in docs]
    want = sorted(zip([d.doc_id for d in docs], [f"{x:016x}" for x in fps], classes(fps, [d.doc_id for d in docs]), strict=True))
    assert sorted(map(tuple, simhash.query(spark, sf).collect())) == want


def planted():
    rng = random.Random(5)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randint(0, 12)):  # chains of up to 4 flips
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    return sorted(set(fps))


def test_links_and_components(spark):
    fps = planted()
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = classes(fps, fps)
    for split in (20_000, 2):  # crowded variants are indexed again
        stars = {r.node: r.root for r in simhash.components(simhash.links(nodes, split_above=split)).collect()}
        got = {}
        for x in fps:
            r = stars.get(simhash._signed(x), simhash._signed(x))
            got.setdefault(r, set()).add(x)
        expected = {}
        for x, c in zip(fps, want, strict=True):
            expected.setdefault(c, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_variants():
    """Whatever four bits differ, a variant leaves them all out; deeper indexes do the same for the bits left free."""
    rng = random.Random(1)
    for fixed in (0, simhash.fixed_bits(1), simhash.fixed_bits(64 * 44 + 9), simhash.fixed_bits(64 * (64 * 30 + 2) + 17)):
        masks = [m for m, _ in simhash.variants(fixed)]
        assert all(m & fixed == fixed for m in masks) and len(masks) < 63
        free = [i for i in range(64) if not fixed >> i & 1]
        for _ in range(300):
            d = sum(1 << i for i in rng.sample(free, 4))
            assert any(not d & m for m in masks)


def test_dense_cluster(spark):
    """Thousands of fingerprints within a few bits: crowded at every index, and one component."""
    rng = random.Random(3)
    x = rng.getrandbits(64)
    fps = {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(50)}
    want = {min(c) for c in _groups(sorted(fps))}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    stars = simhash.components(simhash.links(nodes, split_above=100)).collect()
    roots = {}
    for f in fps:
        roots.setdefault(next((r.root for r in stars if r.node == simhash._signed(f)), simhash._signed(f)), set()).add(f)
    assert {min(c) for c in roots.values()} == want and sorted(map(len, roots.values())) == sorted(map(len, _groups(sorted(fps))))


def _groups(fps):
    out = {}
    for x, c in zip(fps, classes(fps, fps), strict=True):
        out.setdefault(c, set()).add(x)
    return list(out.values())


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    x, y, z = "one two three four five six", "seven eight nine ten eleven twelve", "other words that nothing else has here"
    docs = spark.createDataFrame([(3, x, 1), (5, x, 2), (5, y, 3), (9, z, 4), (9, z, 4), (9, z, 5)], "_quarry_id long, text string, fp int").withColumnRenamed("_quarry_id", "doc_id")
    kept = sorted((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect())
    assert kept == [(3, x), (5, y), (9, z)]
    odd = docs.withColumnsRenamed({"fp": "component_id"}).withColumn("digest", F.lit("d")).withColumn("root", F.lit(None).cast("string"))
    out = simhash.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == 3
    assert simhash.deduplicate(odd.limit(0)).collect() == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_edges(spark):
    docs = spark.createDataFrame([(3, None, "a"), (2, "", "b"), (5, "x y z", "c"), (5, "x y z", "c"), (None, "x y z", "d"), (7, "X  Y\nZ", "e"), (None, "alone here", "f")], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(3, 2), (2, 2), (5, 5), (5, 5), (None, 5), (7, 5), (None, None)], key=repr)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, "d"), (0, "f"), (2, "b"), (5, "c")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
