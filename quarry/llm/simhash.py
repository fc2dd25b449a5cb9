"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles.  With 4 differing bits, three segments suffice for one of them
to differ by at most one bit; more exactly, either one of the first two differs
by at most one bit or the third not at all (two, two and one would be five).
So the first two are indexed under every variant that leaves one of their bits
out, the third as it is: 44 rows for a fingerprint.  Fingerprints that agree on
a variant are compared in full.

Documents with the same fingerprint are one node from the start, combined
before the shuffle, so copies are never paired.  Under a variant, fingerprints
are compared in blocks inside one task and only links of a spanning forest
leave it: at most one link per fingerprint and variant, however many there are
that agree.  A pair that agrees on several variants is looked at under the
first of them only.

A variant with more than `split_above` fingerprints is crowded.  These are first
compared within hashed blocks of bounded size; a crowded group that is one
component by then has nothing to add and is done.  The others are indexed
again, by variants of the bits that their variant leaves free, and again, until
a group is small or so few bits are free that it can't be large.  What is crowded is found from
the counts of the segments' values, three rows for a fingerprint.

Links become components by alternating star contraction over tables in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, remove, shuffle_partitions, table

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 3
#: Fingerprints under one variant that a single task compares with one another.
SPLIT_ABOVE = 20_000
#: Free bits at which a group is small for certain: at most 2 ** 14 fingerprints.
FEW_BITS = 14


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: bit i is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        begin = (end - size)[:n].tolist()
        end = end[shingle - 1 :].tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)]
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        block = np.array(hashes[a : a + (1 << 14)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        values = np.array([fingerprint(x.as_py() or b"") for x in text], np.uint64).view(np.int64)
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(values)], names=[*(batch.schema.names[i] for i in rest), "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null and empty texts have fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- links


def variants(fixed: int = 0) -> list[tuple[int, int]]:
    """(mask, wildcard) of every variant of the bits outside `fixed`, in the order of their numbers.

    mask: the bits that must agree, those of `fixed` included; wildcard: the bit left out, 0 for the last segment.
    """
    free = [1 << i for i in range(64) if not fixed >> i & 1]
    first, second = -(-len(free) // SEGMENTS), -(-2 * len(free) // SEGMENTS)
    out = []
    for part in (free[:first], free[first:second]):
        whole = sum(part)
        out += [(fixed | whole & ~bit, bit) for bit in part]
    return [*out, (fixed | sum(free[second:]), 0)]


def fixed_bits(path: int) -> int:
    """The mask of a group: path has a base-64 digit for each index, the variant's number plus 1, the latest lowest."""
    digits, mask = [], 0
    while path:
        digits.append(path % 64 - 1)
        path //= 64
    for d in reversed(digits):
        mask = variants(mask)[d][0]
    return mask


def _first_variant(difference: np.ndarray) -> np.ndarray:
    """The number of the first variant on which fingerprints with this difference agree; -1 if there is none."""
    out = np.full(difference.shape, -1, np.int64)
    for number, (mask, _) in reversed(list(enumerate(variants()))):
        out[(difference & np.uint64(mask)) == 0] = number
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(fps: np.ndarray, first: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of these fingerprints; only pairs whose first variant is `first` count (any, if negative)."""
    from_, to = [], []
    label = np.arange(fps.size)
    step = max(1, (1 << 20) // fps.size)
    for a in range(0, fps.size, step):
        difference = fps[a : a + step, None] ^ fps[None, :]
        near = np.bitwise_count(difference) <= distance
        near &= np.arange(fps.size) > np.arange(a, min(a + step, fps.size))[:, None]
        for i in np.flatnonzero(near.any(1)).tolist():
            j = np.flatnonzero(near[i])
            j = j[label[j] != label[a + i]]
            if first >= 0 and j.size:
                j = j[_first_variant(difference[i, j]) == first]
            if j.size:
                others, at = np.unique(label[j], return_index=True)
                from_.append(np.full(at.size, a + i))
                to.append(j[at])
                label[np.isin(label, others)] = label[a + i]
    if not from_:
        return fps[:0], fps[:0]
    return fps[np.concatenate(from_)], fps[np.concatenate(to)]


def _linker(distance: int, first_only: bool = True):
    """Over rows (path, k, fp) sorted by path and k: the links among rows that agree on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def top(path: np.ndarray) -> np.ndarray:
            """The first index's variant number of each path."""
            out = path.copy()
            while (more := out >= 64).any():
                out[more] //= 64
            return out - 1

        def found(rows: np.ndarray) -> pa.RecordBatch | None:
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, rows.shape[1]))
            number = top(rows[0, begin]) if first_only else np.full(begin.size, -1)
            # Twos, by far the most, all at once.
            two = size == 2
            x, y = rows[2, begin[two]].view(np.uint64), rows[2, begin[two] + 1].view(np.uint64)
            near = np.flatnonzero(np.bitwise_count(x ^ y) <= distance)
            if first_only:
                near = near[_first_variant((x ^ y)[near]) == number[two][near]]
            a, b = [x[near]], [y[near]]
            many = size > 2
            for s, n, v in zip(begin[many].tolist(), size[many].tolist(), number[many].tolist(), strict=True):
                p, q = _forest(np.ascontiguousarray(rows[2, s : s + n]).view(np.uint64), v, distance)
                a.append(p)
                b.append(q)
            a, b = np.concatenate(a), np.concatenate(b)
            if a.size:
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
            return None

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if held is not None:
                rows = np.concatenate([held, rows], 1)
            if not rows.shape[1]:
                continue
            last = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0))
            cut = int(last[-1]) + 1 if last.size else 0
            held = rows[:, cut:]
            if cut and (out := found(rows[:, :cut])) is not None:
                yield out
        if held is not None and (out := found(held)) is not None:
            yield out

    return run


def _compared(rows: DataFrame, distance: int, first_only: bool = True) -> DataFrame:
    """The links among rows (path, k, fp) of each group."""
    dealt = rows.select("path", "k", "fp").repartition("path", "k").sortWithinPartitions("path", "k", "fp")
    return dealt.mapInArrow(_linker(distance, first_only), "a long, b long")


def _indexed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(path, k, fp): a row for each fingerprint and variant."""
    entries = F.array(*[F.struct(F.lit(v + 1).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k")) for v, mask in enumerate(masks)])
    return fps.select("fp", F.explode(entries).alias("_e")).select("_e.path", "_e.k", "fp")


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, k, fp) -> their variants of the bits that are free."""
    for batch in batches:
        path, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
        for p in np.unique(path).tolist():
            own = fp[path == p]
            masks = np.array([m for m, _ in variants(fixed_bits(p))], np.uint64).view(np.int64)
            for a in range(0, own.size, 4096):
                k = own[a : a + 4096, None] & masks
                paths = np.broadcast_to(64 * p + 1 + np.arange(masks.size), k.shape)
                columns = [paths.reshape(-1), k.reshape(-1), np.repeat(own[a : a + 4096], masks.size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["path", "k", "fp"])


def _crowded_keys(fps: DataFrame, split_above: int) -> DataFrame:
    """(cp, ck) of the first index's variants that may have more than `split_above` fingerprints.

    A variant's fingerprints are those of one or two values of its segment; if
    neither has over half of `split_above`, the variant isn't crowded.
    """
    own = variants()
    by_segment: dict[int, list[tuple[int, int]]] = {}
    for v, (mask, bit) in enumerate(own):
        by_segment.setdefault(mask | bit, []).append((v, mask))
    values = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(whole))).alias("value")) for i, whole in enumerate(by_segment)])
    heavy = fps.select(F.explode(values).alias("e")).groupBy("e.s", "e.value").count().filter(F.col("count") > split_above // 2)
    keys = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(v + 1).cast("long").alias("cp"), F.lit(_signed(mask)).alias("m")) for i, group in enumerate(by_segment.values()) for v, mask in group])
    crowded = heavy.select("s", "value", F.explode(F.filter(keys, lambda e: e.s == F.col("s"))).alias("e"))
    return crowded.select("e.cp", F.col("value").bitwiseAND(F.col("e.m")).alias("ck")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): links among distinct fingerprints fp that connect whatever pairs at `distance` or less connect."""
    if distance > DISTANCE:
        raise ValueError("three segments serve a distance of at most 4")
    spark = fps.sparkSession
    # Few rows in few files become many: they are dealt out before.
    fps = fps.select("fp").repartition(shuffle_partitions(spark))
    index = _indexed(fps, [mask for mask, _ in variants()])
    crowded = materialize(_crowded_keys(fps, split_above), "crowded")
    if crowded.isEmpty():
        return _compared(index, distance)
    on = (F.col("path") == F.col("cp")) & (F.col("k") == F.col("ck"))
    found = materialize(_compared(index.join(crowded, on, "left_anti"), distance), "links")
    rows = materialize(index.join(crowded, on, "left_semi"), "crowded-rows")
    few = F.udf(lambda p: 64 - fixed_bits(p).bit_count() <= FEW_BITS, "boolean")
    while True:
        # Blocks of each group, picked by a hash: any link found is one, and most of a group's are found this way.
        sizes = rows.groupBy("path", "k").agg((F.count("*") * 2 / split_above + 1).cast("long").alias("_blocks")).select(F.col("path").alias("cp"), F.col("k").alias("ck"), "_blocks")
        block = F.pmod(F.xxhash64("path", "fp"), F.col("_blocks"))
        more = _compared(rows.join(sizes, on).select("path", F.xxhash64("k", block).alias("k"), "fp"), distance, first_only=False)
        found = _joined(found, more)
        # Groups that are one component have nothing to add.
        stars = components(found)
        placed = rows.join(stars, rows.fp == stars.node, "left").select("path", "k", F.coalesce("root", "fp").alias("root"))
        mixed = placed.groupBy(F.col("path").alias("cp"), F.col("k").alias("ck")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("cp", "ck")
        deeper = materialize(rows.join(mixed, on, "left_semi").mapInArrow(_again, "path long, k long, fp long"), "crowded-again")
        remove(rows)
        counted = deeper.groupBy("path", "k").count().filter("count > 1").select(F.col("path").alias("cp"), F.col("k").alias("ck"), (F.col("count") > split_above).alias("_more"))
        # Whether few bits are free depends on the path alone, so the test runs on big groups only.
        sizes = materialize(counted.withColumn("_more", F.when(F.col("_more"), ~few("cp")).otherwise(False)), "crowded-sizes")
        found = _joined(found, _compared(deeper.join(sizes.filter("NOT _more"), on, "left_semi"), distance))
        if sizes.filter("_more").isEmpty():
            return found
        rows = materialize(deeper.join(sizes.filter("_more"), on, "left_semi"), "crowded-rows")
        remove(deeper)


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables of links as one, written; `found` is gone after that."""
    out = materialize(found.unionByName(more).distinct(), "links")
    remove(found)
    return out


# ---- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round hangs every neighbour on the smallest node around (large star),
    then every node on its smallest parent (small star), until nothing moves.
    Minima are combined before each shuffle; the only other thing moved is the
    edges, one row each.  Every round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        # Done when every edge leads from a node with no other edge upwards to a node with none: all are stars.
        upwards = now.groupBy("u").agg(F.count("*").alias("_n"))
        if upwards.filter("_n > 1").isEmpty() and now.join(upwards.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialize(small, "stars")
        remove(now)
        now = after
    raise RuntimeError("components did not settle")


def _classes(marked: DataFrame, distance: int) -> DataFrame:
    """(_fp, component_id, root) for every fingerprint of marked (doc_id, fp): the component's smallest doc_id and smallest fingerprint."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(links(nodes, distance))
    linked = stars.join(nodes, stars.node == nodes.fp).select("node", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("below"))
    roots = roots.join(nodes, roots.root == nodes.fp).select("root", F.least("below", "least").alias("component_id"))
    member = linked.select("node", "root").join(roots, "root").select("node", "component_id", "root")
    group = member.unionByName(roots.select(F.col("root").alias("node"), "component_id", "root"))
    # Of most fingerprints the component is their own rows.
    own = nodes.join(group, nodes.fp == group.node, "left").select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return materialize(own, "classes")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id for every row of docs (doc_id, text).

    component_id: the smallest doc_id that links lead to, the row's own
    included.  A null id never is the smallest unless all are null.  Rows that
    share an id are rows of their own with one id; exact copies meet in their
    fingerprint, as do all texts without words.  An empty table gives no rows.
    """
    marked = materialize(with_fingerprints(docs), "fingerprints")
    return marked.join(_classes(marked, distance), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The row of the smallest doc_id of each group, with the columns of docs.

    Rows are told apart by id and text, not by id alone: of rows that share an
    id, each stays that stands first in its group.  Among several with the
    smallest id of a group the least SHA-256 of the text decides; rows that
    share that as well leave one, the least by a hash of their columns.  A row
    without an id is kept, as nothing names it.  Null and empty texts are one
    group.  Columns may have any names.  An empty table stays empty.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    marked = materialize(docs.select("doc_id", "text", digest.alias("digest")).mapInArrow(_fingerprints, "doc_id long, digest string, fp long"), "fingerprints")
    classes = _classes(marked, distance)
    named = marked.filter("doc_id IS NOT NULL").groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("rows"))
    first = F.min(F.struct("doc_id", "digest", "rows")).alias("first")
    kept = named.join(classes, F.col("fp") == F.col("_fp")).groupBy("root").agg(first)
    kept = materialize(kept.select(F.col("first.doc_id").alias("_quarry_id"), F.col("first.digest").alias("_quarry_digest"), F.col("first.rows").alias("_quarry_rows")), "kept")
    on = (F.col("doc_id") == F.col("_quarry_id")) & (digest == F.col("_quarry_digest"))
    out = docs.join(kept.filter("_quarry_rows = 1"), on, "left_semi")
    repeated = kept.filter("_quarry_rows > 1")
    if not repeated.isEmpty():
        hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()]
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = docs.join(repeated, on).groupBy("_quarry_id", "_quarry_digest").agg(F.min_by(whole, F.xxhash64(*hashed)).alias("_quarry_row"))
        out = out.unionByName(one.select("_quarry_row.*"))
    return out.unionByName(docs.filter("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
