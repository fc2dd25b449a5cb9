"""Benchmark decontamination with suffix arrays over the training texts.

A shard is a run of whole documents (of a very long one, a run of its words).
Its suffix array orders every word position by the words that follow, to the
depth of a window, by prefix doubling: ranks of 1, 2, 4, 8 and 13 words.  Every
suffix of the benchmark, cut at a window, is binary-searched in that order, all
of them at once and word by word; the range found gives all its locations, and
runs of locations one word apart are its longest verbatim matches.

Windows are `window` consecutive words of an item; an item with fewer words is
one window of its own.  The benchmark goes to the executors in blocks of at
most BLOCK_BYTES of text.  A task builds a shard's array once and takes the
blocks one after the other, so neither its memory nor the number of stages
grows with them.  Nothing is shuffled, and no hot key can arise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_slices
from .words import by_text

WINDOW = 13
#: A document is contaminated when at least one of its words in this many is hit.
HIT_SHARE = 20
#: Benchmark text in one broadcast block; its windows take some twenty times that on an executor.
BLOCK_BYTES = 2 << 20
#: Words of a shard.
SHARD_WORDS = 1 << 20


class Windows:
    """A block of benchmark items: their distinct windows, and where each stands."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        raw = [text.encode("utf-8", "surrogatepass") for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        hashes, _, _, item = by_text(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.names = ["" if name is None else str(name) for name, _ in items]
        n = np.bincount(item, minlength=len(items))
        start = np.concatenate([[0], np.cumsum(n)])
        #: words in a window -> (distinct windows, first entry of each, owning items, word positions in them)
        self.by_size: dict[int, tuple] = {}
        for size in sorted({int(min(window, x)) for x in n if x}):
            of = np.flatnonzero(n >= window) if size == window else np.flatnonzero(n == size)
            count = n[of] - size + 1
            owner = np.repeat(of, count)
            place = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
            rows = hashes[(start[owner] + place)[:, None] + np.arange(size)]
            distinct, number = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(number, kind="stable")
            first = np.searchsorted(number[order], np.arange(len(distinct) + 1))
            self.by_size[size] = (distinct, first, owner[order], place[order])


class SuffixArray:
    """The word positions of a shard, in the order of the words from each on, to `depth` of them and no further than its text."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        #: Words are numbered from 1 in the order of their hashes; 0 is the end of a text.
        self.ids, self.text = ids + 1, text
        rank, width = self.ids, 1
        while width < depth:
            step = min(width, depth - width)  # the last two pieces overlap, which changes neither equality nor order
            _, number = np.unique(rank * (int(rank.max(initial=0)) + 1) + self._ahead(rank, step), return_inverse=True)
            rank, width = number + 1, width + step
        self.order = np.argsort(rank, kind="stable")
        self.first = np.searchsorted(self.ids[self.order], np.arange(self.vocabulary.size + 2))

    def _ahead(self, values: np.ndarray, step: int) -> np.ndarray:
        """The value `step` words on in the same text; 0 beyond its end."""
        out = np.zeros(values.size, np.int64)
        if step < values.size:
            out[:-step] = np.where(self.text[step:] == self.text[:-step], values[step:], 0)
        return out

    def _word(self, at: np.ndarray, k: int) -> np.ndarray:
        """Word k of the suffixes at these places in the order; 0 if their text is over."""
        here = self.order[np.minimum(at, self.order.size - 1)]
        there = np.minimum(here + k, self.ids.size - 1)
        return np.where((here + k < self.ids.size) & (self.text[there] == self.text[here]), self.ids[there], 0)

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, k: int, after: bool) -> np.ndarray:
        """Where in [low, high) the suffixes' word k reaches (or, after, passes) these words: one binary search for each, all together."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            own = self._word(middle, k)
            below = open_ & ((own <= word) if after else (own < word))
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, low, high) of the windows (rows of word hashes) that occur: their suffixes are order[low:high]."""
        none = np.zeros(0, np.int64)
        if not self.order.size or not len(windows):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, windows), self.vocabulary.size - 1)
        which = np.flatnonzero((self.vocabulary[at] == windows).all(1))
        words = at[which] + 1
        low, high = self.first[words[:, 0]], self.first[words[:, 0] + 1]
        for k in range(1, windows.shape[1]):
            low, high = self._bound(low, high, words[:, k], k, False), self._bound(low, high, words[:, k], k, True)
            some = low < high
            which, words, low, high = which[some], words[some], low[some], high[some]
        return which, low, high


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each, end to end."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Shard:
    """Texts given as word hashes and text numbers, in suffix arrays of bounded size that overlap by a window less a word."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray, depth: int, most: int = SHARD_WORDS):
        self.n, self.text = hashes.size, text
        self.parts = [(a, SuffixArray(hashes[a : a + most + depth - 1], text[a : a + most + depth - 1], depth)) for a in range(0, hashes.size, most)]

    def locations(self, block: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, number of a distinct window, word position) of every occurrence, size by size and part by part."""
        for size, (distinct, _, _, _) in block.by_size.items():
            for begin, array in self.parts:
                which, low, high = array.search(distinct)
                yield size, np.repeat(which, high - low), array.order[_spread(low, high - low)] + begin

    def matches(self, block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (a mask), and the (text, item) pairs with an occurring window."""
        change = np.zeros(self.n + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for size, number, at in self.locations(block):
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            seen = np.unique(np.stack([self.text[at], number], 1), axis=0)
            _, first, owner, _ = block.by_size[size]
            many = first[seen[:, 1] + 1] - first[seen[:, 1]]
            pairs.append(np.unique(np.stack([np.repeat(seen[:, 0], many), owner[_spread(first[seen[:, 1]], many)]], 1), axis=0))
        both = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(change[:-1]) > 0, both[:, 0], both[:, 1]

    def longest(self, block: Windows) -> list[tuple[int, int, int, int, int]]:
        """(text, item, position in the shard, position in the item, words) of every maximal verbatim match."""
        found: dict[int, list] = {}
        for size, number, at in self.locations(block):
            found.setdefault(size, []).append((number, at))
        out = []
        for size, parts in found.items():
            _, first, owner, place = block.by_size[size]
            number, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            many = first[number + 1] - first[number]
            entry = _spread(first[number], many)
            rows = np.unique(np.stack([owner[entry], np.repeat(at, many) - place[entry], np.repeat(at, many)], 1), axis=0)
            if not len(rows):
                continue
            item, shift, at = rows.T
            new = np.ones(at.size, bool)
            new[1:] = (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(at) != 1)
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, at.size)) + size - 1
            out += [(int(self.text[at[b]]), int(item[b]), int(at[b]), int(at[b] - shift[b]), int(w)) for b, w in zip(begin, length, strict=True)]
        return out


def _blocks(benchmark: DataFrame, window: int, most: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The benchmark, a block at a time; at least one block."""
    held, size, made = [], 0, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = row.text or ""
        if held and size + 4 * len(text) > most:
            yield Windows(held, window)
            held, size, made = [], 0, made + 1
        held.append((row.item_id, text))
        size += len(text.encode("utf-8", "surrogatepass"))
    if held or not made:
        yield Windows(held, window)


def _runs(mask: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge.tolist()


_WORDS, _HITS, _ITEMS, _HIT = "_quarry_words", "_quarry_hits", "_quarry_items", "_quarry_n_hit"


def _shared(benchmark: DataFrame, window: int) -> list:
    """The blocks as broadcast variables; an executor fetches one when a task first comes to it."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(cloudpickle.dumps(block)) for block in _blocks(benchmark, window)]


def _marker(shared: list, kept: list[str], window: int):
    """All blocks over every batch; keeps the columns `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A single block stays unpacked; of several, one at a time.
        held = pickle.loads(shared[0].value) if len(shared) == 1 else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for a, b, raw, offsets in utf8_slices(column):
                hashes, _, _, text = by_text(raw, offsets)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                shard = Shard(hashes, text, window)
                mask = np.zeros(hashes.size, bool)
                items: dict[int, set[str]] = {}
                for one in shared:
                    block = held or pickle.loads(one.value)
                    hit, of, item = shard.matches(block)
                    mask |= hit
                    for k, i in zip(of.tolist(), item.tolist(), strict=True):
                        items.setdefault(k, set()).add(block.names[i])
                hits = [_runs(mask[bounds[k] : bounds[k + 1]]) if k in items else [] for k in range(b - a)]
                part = batch.slice(a, b - a)
                arrays = [part.column(part.schema.get_field_index(name)) for name in kept]
                arrays += [pa.array(np.diff(bounds), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(items.get(k, ())) for k in range(b - a)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, _WORDS, _HITS, _ITEMS])

    return run


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, kept: list[str]) -> DataFrame:
    """The columns `kept` of docs with words, hit runs (begin, end, begin, ...), items, and n_hit as the last."""
    schema = ", ".join([*(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept), f"{_WORDS} long", f"{_HITS} array<int>", f"{_ITEMS} array<string>"])
    out = docs.mapInArrow(_marker(_shared(benchmark, window), kept, window), schema)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(_HITS) - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 1, 1).otherwise(-1) * F.get(F.col(_HITS), i))
    return out.withColumn(_HIT, F.when(F.size(_HITS) > 0, n_hit).otherwise(F.lit(0).cast("long")))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Whether at least one word in HIT_SHARE is hit."""
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with n_words, n_hit, hit_runs, item_ids and contaminated.

    docs needs a column text; benchmark item_id and text.  Null and empty texts
    have no words; a null item id counts as the id ''.  Every row is judged by
    itself, so repeated ids don't matter; empty tables give no hits or no rows.
    keep: columns of docs in the result (all); of the result's own names, the
    result's columns stay.
    """
    named = {_WORDS: "n_words", _HIT: "n_hit", _HITS: "hit_runs", _ITEMS: "item_ids"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*named.values(), "contaminated")]
    out = _marked(docs, benchmark, window, kept).withColumnsRenamed(named)
    return out.select(*kept, *named.values(), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: every maximal verbatim match and where it lies, counted in words.

    Matches end where a block of the benchmark's item does; items are never split.
    """
    shared = _shared(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in utf8_slices(batch.column(1)):
                hashes, _, _, text = by_text(raw, offsets)
                begin = np.searchsorted(text, np.arange(b - a + 1))
                shard = Shard(hashes, text, window)
                ids = batch.column(0).slice(a, b - a).to_pylist()
                for one in shared:
                    own = pickle.loads(one.value)
                    rows = shard.longest(own)
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "item_id": pa.array([own.names[r[1]] for r in rows], pa.string()), "doc_word": pa.array([r[2] - int(begin[r[0]]) for r in rows], pa.int64()), "item_word": pa.array([r[3] for r in rows], pa.int64()), "n_words": pa.array([r[4] for r in rows], pa.int64())}
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id string, doc_word long, item_word long, n_words long")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows, columns as they were."""
    return _marked(docs, benchmark, window, docs.columns).filter(~contaminated(F.col(_HIT), F.col(_WORDS))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents against the whole benchmark."""
    rows = flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )
