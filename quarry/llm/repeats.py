"""Repeated 200-byte windows of a corpus by a distributed, depth-limited radix sort.

Every window of `depth` bytes is a suffix cut at the threshold; windows are
repeated exactly where the radix sort leaves them in one group.  The first
digit of a window is its minimizer: of the k-byte strings in it, the one with
the least hash (the leftmost of several).  Equal windows have equal minimizers
in the same place, and neighbouring windows mostly share theirs, so the first
pass needs one row for a run of windows (a segment), not one for each byte.

Pass 1 counts the minimizers.  Segments of a minimizer that occurs once hold no
repeated window.  If all segments of a minimizer are equal, all their windows
are repeated.  Only of the others, at the edges of what is repeated, bytes are
moved: distinct segments of one minimizer meet in a task, which orders their
windows by most-significant-digit passes of 8 bytes, dropping a window as soon
as it is alone in its group.  A minimizer with more than `split_above` distinct
segments is too much for one task.  Its segments are put in order over the whole
cluster, once by what stands right of the minimizer and once by what stands left
of it, and each run of `chunk` neighbours is radix-sorted by itself.  A window
found there is repeated.  The longest context that a segment shares with any
other on either side is that of a neighbour in these orders, so windows that
reach beyond both are alone.  Windows that neither settles are few: they are
looked up among all windows of their minimizers, or, should they be many, their
minimizers' segments are split by stretches around the minimizer, which are
counted with a combine before the shuffle and split again where neither alone
nor all equal.  No task sees a large group.

Copies of a text are combined before anything is counted.  Texts cross the
network once, compressed; those with edges to resolve are kept for a second,
smaller join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, utf8_slices

DEPTH = 200
#: Bytes of a minimizer.
GRAM = 32
#: Distinct segments of a minimizer that one task sorts.
SPLIT_ABOVE = 256
#: Parts that a pass makes of a crowded minimizer's windows, and tasks among which one stretch is dealt.
WAYS = 6
SALTS = 16
#: Neighbouring segments of a crowded minimizer that are radix-sorted together.
CHUNK = 256
#: Windows looked up by a broadcast of their 8-byte hashes; if more are open, segments are split by stretches instead.
MOST_OPEN = 1 << 18
BLOCK = 4 << 20

_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)

SEGMENT = "struct<start:int,pre:int,n:int,key:long,dig:long>"


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each position on; too short by gram - 1."""
    h, size, level = _TABLE[raw], 1, 0
    while size < gram:
        h = h[:-size] * _MULT[level] + h[size:]
        size, level = 2 * size, level + 1
    h = (h ^ (h >> np.uint64(31))) * _MULT[1]
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each position on."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: v.size - (width - size)], v[width - size :]) if size < width else v


def segments(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: (text, start, minimizer's offset, windows, minimizer's hash).

    start counts from the beginning of all the bytes.
    """
    none = np.zeros(0, np.int64)
    if raw.size < depth:
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(raw, gram)
    packed = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(hashes.size, dtype=np.uint64)
    at = (_least(packed, depth - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    text = np.repeat(np.arange(size.size), size)[: at.size]
    valid = np.arange(at.size) + depth <= offsets[1:][text]
    where = np.flatnonzero(valid)
    if not where.size:
        return none, none, none, none, np.zeros(0, np.uint64)
    new = np.ones(where.size, bool)
    new[1:] = (np.diff(at[where]) != 0) | (np.diff(where) != 1) | (np.diff(text[where]) != 0)
    first = np.flatnonzero(new)
    start = where[first]
    n = np.diff(np.concatenate([first, [where.size]]))
    return text[start], start, at[start] - start, n, hashes[at[start]]


def _digest(text: bytes) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), "<i8")
    return int(d[0]), int(d[1])


def _long_text_segments(raw: np.ndarray, depth: int, gram: int):
    """Segments of one text in blocks of bounded size that overlap by a window less one byte."""
    for a in range(0, max(1, raw.size - depth + 1), BLOCK):
        block = raw[a : a + BLOCK + depth - 1]
        _, start, pre, n, key = segments(block, np.array([0, block.size]), depth, gram)
        yield start + a, pre, n, key


def _segmenter(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        kind = pa.list_(pa.struct([("start", pa.int32()), ("pre", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("dig", pa.int64())]))
        for batch in batches:
            for a, b, raw, offsets in utf8_slices(batch.column(0), 1 << 20):
                whole = memoryview(raw.tobytes())
                if b - a == 1 and raw.size > BLOCK:
                    parts = list(_long_text_segments(raw, depth, gram))
                    start, pre, n, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                    text = np.zeros(start.size, np.int64)
                else:
                    text, start, pre, n, key = segments(raw, offsets, depth, gram)
                digs = np.array([xxh3_64_intdigest(whole[s:e]) for s, e in zip(start.tolist(), (start + n + depth - 1).tolist(), strict=True)], np.uint64)
                names = [_digest(whole[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                bounds = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int32()) for x in (start - offsets[text], pre, n)] + [pa.array(key.view(np.int64)), pa.array(digs.view(np.int64))],
                    names=["start", "pre", "n", "key", "dig"],
                )
                lists = pa.ListArray.from_arrays(pa.array(bounds), flat).cast(kind)
                out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), lists], names=["h1", "h2", "segs"])
                yield out.filter(pa.array(np.diff(bounds) > 0))

    return run


# ---- the passes over edges


def radix_equal(raw: np.ndarray, group: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows raw[start : start + depth] equal another of their group.

    Most-significant-digit passes: a digit is 8 bytes; after each, windows are
    grouped by what they were grouped by before and the digit, and those alone
    in their group are out.
    """
    out = np.zeros(start.size, bool)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (raw.size + 1, 8), (1, 1))
    active = np.arange(start.size)
    group = group.astype(np.int64)
    for digit in range(-1, (depth + 7) // 8):
        if digit < 0:
            value = np.zeros(active.size, np.uint64)
        else:
            at = start[active] + 8 * digit
            value = np.ascontiguousarray(words[at]).view(">u8").reshape(-1).astype(np.uint64)
            if 8 * digit + 8 > depth:
                value >>= np.uint64(8 * (8 * digit + 8 - depth))
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        new = np.ones(order.size, bool)
        new[1:] = (np.diff(g) != 0) | (v[1:] != v[:-1])
        number = np.cumsum(new) - 1
        crowd = np.bincount(number, minlength=1)[number] > 1 if order.size else np.zeros(0, bool)
        active, group = active[order][crowd], number[crowd]
        if not active.size:
            return out
    out[active] = True
    return out


def _runs(offsets: np.ndarray) -> list[int]:
    """Sorted numbers -> [first, end, first, end, ...] of their runs."""
    if not offsets.size:
        return []
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return np.stack([offsets[np.concatenate([[0], cut + 1])], offsets[np.concatenate([cut, [offsets.size - 1]])] + 1], 1).reshape(-1).tolist()


_SOLVED = "key long, dig long, runs array<int>"


def _solved(key, dig, runs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(dig, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["key", "dig", "runs"])


def _repeated_in(rows: list[dict], depth: int) -> list[list[int]]:
    """The windows of every row (key, dig, times, pre, n, bytes) that another of these rows has, as runs of offsets."""
    raw = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    size = np.array([len(r["bytes"]) for r in rows])
    n = np.array([r["n"] for r in rows])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
    # Windows can only be equal if their minimizer is as far into them.
    numbers = {k: i for i, k in enumerate(dict.fromkeys(r["key"] for r in rows))}
    group = np.array([numbers[r["key"]] for r in rows])[owner] * (2 * depth) + np.array([r["pre"] for r in rows])[owner] - offset
    same = radix_equal(raw, group, begin[owner] + offset, depth)
    bounds = np.cumsum(n)
    return [[0, r["n"]] if r["times"] > 1 else _runs(np.flatnonzero(same[b - r["n"] : b])) for r, b in zip(rows, bounds.tolist(), strict=True)]


def _sorter(depth: int):
    """Rows (key, dig, times, pre, n, bytes) sorted by key -> the repeated windows of every segment, as runs of offsets."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        return _solved([r["key"] for r in rows], [r["dig"] for r in rows], _repeated_in(rows, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= 2048 and r["key"] != held[-1]["key"]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    return run


# ---- crowded minimizers

_NEAR = "key long, dig long, runs array<int>, left int, right int, times long, pre int, n int, bytes binary"
_NEAR_ARROW = pa.schema([("key", pa.int64()), ("dig", pa.int64()), ("runs", pa.list_(pa.int32())), ("left", pa.int32()), ("right", pa.int32()), ("times", pa.int64()), ("pre", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])


def _shared(parts: list[bytes]) -> np.ndarray:
    """The longer of the beginnings that each part shares with the one before and the one after."""
    size = np.array([len(x) for x in parts])
    out = np.zeros(size.size, np.int64)
    if size.size > 1 and size.max():
        width = int(size.max())
        m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width)
        other = m[1:] != m[:-1]
        common = np.minimum(np.where(other.any(1), other.argmax(1), width), np.minimum(size[1:], size[:-1]))
        out[1:] = common
        out[:-1] = np.maximum(out[:-1], common)
    return out


def _neighbours(depth: int, chunk: int):
    """Rows (key, dig, times, pre, n, bytes) in an order -> repeated windows among neighbours, and the contexts shared with the next ones.

    Rows at the ends of a partition carry their bytes on: their other neighbours are in another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        began = False

        def solve(last: bool) -> pa.RecordBatch:
            nonlocal began
            left, right = _shared([r["bytes"][: r["pre"]][::-1] for r in held]), _shared([r["bytes"][r["pre"] :] for r in held])
            ends = {0} if not began else set()
            ends |= {len(held) - 1} if last else set()
            began = True
            rows = [(r["key"], r["dig"], w, a, b, r["times"], r["pre"], r["n"], r["bytes"] if i in ends else None) for i, (r, w, a, b) in enumerate(zip(held, _repeated_in(held, depth), left.tolist(), right.tolist(), strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NEAR_ARROW, strict=True)], schema=_NEAR_ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["key"] != held[-1]["key"]:
                    yield solve(False)
                    held = []
                elif len(held) >= chunk:
                    yield solve(False)
                    held = held[-1:]  # whose other neighbour is next
                held.append(r)
        if held:
            yield solve(True)

    return run


def _opener(depth: int):
    """Rows (key, dig, times, pre, n, runs, left, right) -> (key, dig, runs, open): open windows may be repeated, but no neighbour has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, rest = [], []
            for r in batch.to_pylist():
                known = np.zeros(r["n"], bool)
                for a, b in zip(r["runs"][::2], r["runs"][1::2], strict=True):
                    known[a:b] = True
                may = np.zeros(r["n"], bool)
                may[max(0, r["pre"] - r["left"]) : max(0, min(r["n"], r["pre"] + r["right"] - depth + 1))] = True
                runs.append(_runs(np.flatnonzero(known)))
                rest.append(_runs(np.flatnonzero(may & ~known)))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind), pa.array(rest, kind)], names=["key", "dig", "runs", "open"])

    return run


_WINDOW = "key long, dig long, times long, at int, place int, window binary"


def _asker(depth: int):
    """Rows (key, dig, times, pre, n, bytes, open) -> a row for each open window; place: its bytes before the minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["key"], r["dig"], r["times"], w, r["pre"] - w, r["bytes"][w : w + depth]) for r in batch.to_pylist() for a, b in zip(r["open"][::2], r["open"][1::2], strict=True) for w in range(a, b)]
            if rows:
                yield _windows_of(rows)

    return run


def _windows_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _WINDOW.split(", ")])


def _answerer(depth: int, shared):
    """Rows (key, dig, times, pre, n, bytes) -> those of their windows that were asked for, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = frozenset(shared.value.tolist())
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = r["bytes"]
                rows += [(r["key"], r["dig"], r["times"], w, r["pre"] - w, raw[w : w + depth]) for w in range(r["n"]) if _name(raw[w : w + depth]) in asked]
            if rows:
                yield _windows_of(rows)

    return run


def _name(window: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(window)


def _namer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.unique(np.array([_name(x.as_py()) for x in batch.column(0)], np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])


def _crowded(edges: DataFrame, depth: int, gram: int, chunk: int, most_open: int) -> DataFrame:
    """Edges (key, dig, times, pre, n, bytes) of crowded minimizers -> key, dig, runs of repeated windows."""
    spark = edges.sparkSession
    columns = edges.columns
    left = F.reverse(F.hex(F.substring("bytes", F.lit(1), F.col("pre"))))
    right = F.substring("bytes", F.col("pre") + 1, F.lit(depth))
    looks = []
    for order in (["key", "_left", "_right"], ["key", "_right", "_left"]):
        ranged = edges.withColumn("_left", left).withColumn("_right", right).repartitionByRange(*order).sortWithinPartitions(*order)
        looked = materialize(ranged.select(columns).mapInArrow(_neighbours(depth, chunk), _NEAR), "neighbours")
        # Two rows of each partition meet in one task.
        ends = looked.filter(F.col("bytes").isNotNull()).select(columns).withColumn("_left", left).withColumn("_right", right)
        ends = ends.repartition(1).sortWithinPartitions(*order).select(columns)
        looks += [looked, ends.mapInArrow(_neighbours(depth, chunk), _NEAR)]
    every = reduce(DataFrame.unionByName, [x.drop("bytes") for x in looks])
    firsts = [F.first(c).alias(c) for c in ("times", "pre", "n")]
    met = every.groupBy("key", "dig").agg(*firsts, F.flatten(F.collect_list("runs")).alias("runs"), F.max("left").alias("left"), F.max("right").alias("right"))
    known = materialize(met.mapInArrow(_opener(depth), "key long, dig long, runs array<int>, open array<int>"), "known")
    answers = known.select("key", "dig", "runs")
    open_ = known.filter(F.size("open") > 0).select(F.col("key").alias("_key"), F.col("dig").alias("_dig"), "open")
    if open_.isEmpty():
        return answers
    keys = open_.select("_key").distinct()
    among = materialize(edges.join(keys, F.col("key") == F.col("_key"), "left_semi"), "among")
    asked = among.join(open_, (F.col("key") == F.col("_key")) & (F.col("dig") == F.col("_dig"))).select(*columns, "open").mapInArrow(_asker(depth), _WINDOW)
    asked = materialize(asked, "asked")
    if asked.limit(most_open + 1).count() > most_open:
        more = _split_further(among, depth, gram)
    else:
        names = asked.select("window").mapInArrow(_namer, "name long").distinct().collect()
        shared = spark.sparkContext.broadcast(np.array([r.name for r in names], np.int64).view(np.uint64))
        found = among.mapInArrow(_answerer(depth, shared), _WINDOW)
        twice = found.groupBy("key", "place", "window").agg(F.sum("times").alias("_c")).filter("_c > 1").select(F.col("key").alias("_key"), F.col("place").alias("_place"), F.col("window").alias("_window"))
        repeated = asked.join(twice, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")) & (F.col("window") == F.col("_window")), "left_semi")
        more = repeated.groupBy("key", "dig").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + 1))).alias("runs"))
    both = answers.unionByName(more)
    return both.groupBy("key", "dig").agg(F.flatten(F.collect_list("runs")).alias("runs"))


_PIECE = "key long, dig long, times long, off int, pre int, n int, lo int, hi int, bytes binary"
_SPLIT = f"{_PIECE}, s1 long, s2 long, b1 long, b2 long"


def _splitter(depth: int, gram: int, ways: int):
    """Pieces -> their `ways` parts, by how many bytes a window has before its minimizer.

    A piece has windows with lo to hi bytes before the minimizer, so all hold
    the same stretch around it; s is the digest of that stretch, b that of all
    of the part's bytes.  Equal windows are in parts of equal s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.binary()] + [pa.int64()] * 4
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw, pre, step = r["bytes"], r["pre"], -(-(r["hi"] - r["lo"] + 1) // ways)
                for lo in range(r["lo"], r["hi"] + 1, step):
                    hi = min(lo + step - 1, r["hi"])
                    most, least = min(hi, pre), max(lo, pre - r["n"] + 1)
                    if most < least:
                        continue
                    at, n = pre - most, most - least + 1
                    own = raw[at : at + n + depth - 1]
                    shared = _digest(b"%d %d " % (lo, hi) + raw[pre - lo : pre + depth - hi])
                    out.append((r["key"], r["dig"], r["times"], r["off"] + at, most, n, lo, hi, own, *shared, *_digest(b"%d %d " % (least, most) + own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _split_further(edges: DataFrame, depth: int, gram: int, ways: int = WAYS, salts: int = SALTS) -> DataFrame:
    """Edges (key, dig, times, pre, n, bytes) of crowded minimizers -> key, dig, runs of repeated windows.

    Each pass splits pieces into parts.  A part whose stretch nothing else has
    is done, and so are parts of one stretch that are equal in full: all their
    windows are repeated.  Only the others go on, until a part is one window
    and its stretch all of it.  Counting combines before its shuffle, and the
    join back is salted, so a stretch that very many texts have is no matter.
    """
    pieces = edges.withColumn("off", F.lit(0)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(depth - gram)).select([c.split()[0] for c in _PIECE.split(", ")])
    span, answers = depth - gram + 1, []
    while True:
        parts = materialize(pieces.mapInArrow(_splitter(depth, gram, ways), _SPLIT).withColumn("_salt", F.pmod("b1", F.lit(salts)).cast("int")), "parts")
        ends = [f("b1") for f in (F.min, F.max)] + [f("b2") for f in (F.min, F.max)]
        counted = parts.groupBy("s1", "s2").agg(F.sum("times").alias("_c"), *(e.alias(f"_e{i}") for i, e in enumerate(ends))).filter("_c > 1")
        met = counted.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.expr("_e0 = _e1 and _e2 = _e3").alias("pure"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_to"))
        on = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("_salt") == F.col("_to"))
        judged = materialize(parts.join(met, on).withColumn("bytes", F.when(~F.col("pure"), F.col("bytes"))).select(*pieces.columns, "pure"), "judged")
        answers.append(judged.filter("pure").select("key", "dig", "off", "n"))
        pieces = judged.filter(~F.col("pure")).drop("pure")
        span = -(-span // ways)
        if span == 1 or pieces.isEmpty():
            break
    found = reduce(DataFrame.unionByName, answers)
    return found.groupBy("key", "dig").agg(F.flatten(F.collect_list(F.array(F.col("off"), F.col("off") + F.col("n")))).alias("runs"))


# ---- texts


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
        names = [_digest(x) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([pack(x) for x in raw], pa.binary())], names=["doc_id", "h1", "h2", "z"])


def _report(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str, list[int]]:
    """n_bytes, n_removed, n_spans, kept_sha256, merged spans."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at, gone = hashlib.sha256(), 0, 0
    for a, b in merged:
        kept.update(text[at:a])
        at, gone = b, gone + b - a
    kept.update(text[at:])
    return len(text), gone, len(merged), kept.hexdigest(), [x for s in merged for x in s]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])
_EDGE = "struct<start:int,pre:int,n:int,key:long,dig:long,bytes:binary>"
_EDGES = pa.list_(pa.struct([("start", pa.int32()), ("pre", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("dig", pa.int64()), ("bytes", pa.binary())]))


def _first_look(depth: int):
    """(doc_id, h1, h2, z, copies, found) -> final rows where nothing is open, else what is needed to go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                done, carried = [], []
                for r in part.to_pylist():
                    text = unpack(r["z"])
                    found = r["found"] or []
                    edges = [{k: s[k] for k in ("start", "pre", "n", "key", "dig")} | {"bytes": text[s["start"] : s["start"] + s["n"] + depth - 1]} for s in found if not s["pure"]]
                    if (r["copies"] or 1) > 1:  # a copy of this text repeats all of it
                        spans = [(0, len(text))] if len(text) >= depth else []
                    else:
                        spans = [(s["start"], s["start"] + s["n"] + depth - 1) for s in found if s["pure"]]
                    open_ = bool(edges) and (r["copies"] or 1) == 1
                    done.append((r["doc_id"], *_report(text, spans)))
                    carried.append((r["h1"], r["h2"], r["z"] if open_ else None, edges))
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _OUT, strict=True)]
                h1, h2, z, edges = zip(*carried, strict=True)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(z, pa.binary()), pa.array(edges, _EDGES)], names=[*_OUT.names, "h1", "h2", "z", "edges"])

    return run


def _last_look(depth: int):
    """(doc_id, z, spans, solved) -> final rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans = list(zip(r["spans"][::2], r["spans"][1::2], strict=True))
                for s in r["solved"] or []:
                    spans += [(s["start"] + a, s["start"] + b + depth - 1) for a, b in zip(s["runs"][::2], s["runs"][1::2], strict=True)]
                rows.append((r["doc_id"], *_report(unpack(r["z"]), spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def repeated_windows(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, split_above: int = SPLIT_ABOVE, chunk: int = CHUNK, most_open: int = MOST_OPEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans for every row of docs (doc_id, text).

    A byte is removed if a string of `depth` bytes that covers it starts
    anywhere else, in any row.  spans: [begin, end, ...] of the maximal removed
    runs, in bytes.  Null texts are empty; texts shorter than `depth` lose
    nothing; rows are told apart by their text, not their id, so repeated and
    null ids are no matter, and repeated rows lose everything.  An empty table
    gives no rows.
    """
    parts = docs.select("text").mapInArrow(_segmenter(depth, gram), f"h1 long, h2 long, segs array<{SEGMENT}>")
    texts = materialize(parts.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("segs").alias("segs")), "segments")
    flat = texts.select("h1", "h2", "copies", F.inline("segs"))
    counted = flat.groupBy("key").agg(F.sum("copies").alias("_c"), F.min("dig").alias("_lo"), F.max("dig").alias("_hi")).filter("_c > 1")
    twice = materialize(counted.select(F.col("key").alias("_key"), (F.col("_lo") == F.col("_hi")).alias("pure")), "minimizers")
    found = flat.join(twice, F.col("key") == F.col("_key"))
    by_text = materialize(
        found.groupBy("h1", "h2").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("start", "pre", "n", "key", "dig", "pure")).alias("found")).withColumnsRenamed({"h1": "g1", "h2": "g2"}),
        "found",
    )
    packed = docs.select("doc_id", "text").mapInArrow(_packer, "doc_id long, h1 long, h2 long, z binary")
    met = packed.join(by_text, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("doc_id", "h1", "h2", "z", "copies", "found")
    looked = materialize(met.mapInArrow(_first_look(depth), f"{_RESULT}, h1 long, h2 long, z binary, edges array<{_EDGE}>"), "looked")

    edges = looked.select(F.inline("edges")).groupBy("key", "dig").agg(F.count("*").alias("times"), F.first("pre").alias("pre"), F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    edges = materialize(edges, "edges")
    crowded = materialize(edges.groupBy("key").count().filter(F.col("count") > split_above).select(F.col("key").alias("_key")), "crowded")
    columns = ["key", "dig", "times", "pre", "n", "bytes"]
    few = edges.join(crowded, F.col("key") == F.col("_key"), "left_anti").select(columns)
    solved = few.repartition("key").sortWithinPartitions("key").mapInArrow(_sorter(depth), _SOLVED)
    if not crowded.isEmpty():
        many = materialize(edges.join(crowded, F.col("key") == F.col("_key"), "left_semi").select(columns), "many")
        solved = solved.unionByName(_crowded(many, depth, gram, chunk, most_open))
    solved = materialize(solved.filter(F.size("runs") > 0).withColumnsRenamed({"key": "_key", "dig": "_dig"}), "solved")

    left = looked.filter(F.col("z").isNotNull())
    needs = left.select("h1", "h2", F.inline("edges")).select("h1", "h2", "start", "key", "dig")
    answers = needs.join(solved, (F.col("key") == F.col("_key")) & (F.col("dig") == F.col("_dig"))).groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.collect_list(F.struct("start", "runs")).alias("solved"))
    last = left.join(answers, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("doc_id", "z", "spans", "solved")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return looked.filter(F.col("z").isNull()).select(names).unionByName(last.mapInArrow(_last_look(depth), _RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents."""
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
