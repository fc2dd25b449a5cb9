"""Token ids of a corpus in grammar-compressed shard files.

Documents are dealt by ranges of doc_id and sorted, encoded, cut into shards of
whole documents, and each shard's ids are compressed by Re-Pair: frequent pairs
of neighbouring symbols are replaced by nonterminals, over and over.  A pass
replaces many pairs at once, chosen by frequency such that no two of them can
overlap, so a pass is a handful of array operations; passes go on until no pair
is frequent.  No rule spans the end of
a document; with the expansion length of every rule and the symbol at which
each document starts, one document decodes without the rest of its shard.

A shard file is little-endian:

    magic      8 bytes   b"RPSHARD1"
    n_base     uint32    ids below are terminals; rule r is symbol n_base + r
    n_rules, n_docs, n_symbols   uint32 each
    width      uint32    bytes of a stored symbol, 2 or 4
    rules      n_rules x (left, right), uint32
    lengths    n_rules x uint32: how many ids the rule stands for
    starts     (n_docs + 1) x uint32: first symbol of each document
    symbols    n_symbols x width

The table of shards (part, seq, before, n_tokens, doc_ids, shard) keeps them
in doc_id order: part numbers the ranges, seq the shards of a range, and before
counts the ids of the range's earlier shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, utf8_slices, worker_cache

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"RPSHARD1"
HEAD = "<8s5I"
#: Ids in a shard at which it is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 19
PAIRS_A_PASS = 256
#: A pair is frequent from so many occurrences on, and from one in SHARE of the shard's symbols: a rule takes 12 bytes.
LEAST_COUNT = 32
SHARE = 2048
#: Stands for the pair of a document's last symbol and the next document's first.
NO_PAIR = np.uint64((1 << 64) - 1)
#: Distinct units of text that a Python worker remembers before it starts anew.
REMEMBERED = 800_000
#: New units encoded as one text, and bytes of texts looked through for new units at a time.
JOINED = 256
AT_A_TIME = 8 << 20

SHARDS = "part int, seq int, before long, n_tokens long, doc_ids array<long>, shard binary"


# ---- grammar


SLOT_BITS = 18


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _chosen(codes: np.ndarray, slot: np.ndarray, base: int, most: int, least: int) -> np.ndarray:
    """Codes left * base + right of frequent pairs, none of which can overlap another.

    Pairs are counted by hash slot first and exactly after, so that only codes
    in heavy slots are sorted.
    """
    heavy = np.bincount(slot, minlength=1 << SLOT_BITS) >= least
    kept = codes[heavy[slot]]
    if not kept.size:
        return kept
    found, count = np.unique(kept, return_counts=True)
    order = np.lexsort((found, -count))[: 8 * most]
    lefts: set[int] = set()
    rights: set[int] = set()
    out: list[int] = []
    for c, n in zip(found[order].tolist(), count[order].tolist(), strict=True):
        if n < least or len(out) == most:
            break
        if c == int(NO_PAIR):
            continue
        a, b = divmod(c, base)
        if a == b:
            if a in lefts or a in rights:
                continue
        elif a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        out.append(c)
    return np.sort(np.array(out, np.uint64))


def compress(ids: np.ndarray, ends: np.ndarray, n_base: int, most: int = PAIRS_A_PASS, least: int = LEAST_COUNT):
    """ids (uint32) of documents that end after the positions `ends` -> symbols, rules (n x 2), rule lengths, document starts."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(symbols.size, bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    n = n_base
    while symbols.size >= 2:
        base = n + 1
        codes = symbols[:-1].astype(np.uint64) * np.uint64(base) + symbols[1:]
        codes[last[:-1]] = NO_PAIR
        slot = _slots(codes)
        chosen = _chosen(codes, slot, base, most, max(least, symbols.size // SHARE))
        chosen = chosen[chosen != NO_PAIR]
        if not chosen.size:
            break
        marked = np.zeros(1 << SLOT_BITS, bool)
        marked[_slots(chosen)] = True
        where = np.flatnonzero(marked[slot])
        at = np.searchsorted(chosen, codes[where])
        at[at == chosen.size] = 0
        hit = chosen[at] == codes[where]
        where, at = where[hit], at[hit]
        # Only runs of one symbol paired with itself can overlap: of such a run, every second position starts a pair.
        new_run = np.ones(where.size, bool)
        new_run[1:] = np.diff(where) != 1
        first = np.maximum.accumulate(np.where(new_run, np.arange(where.size), 0))
        odd = (np.arange(where.size) - first) % 2 == 0
        where, at = where[odd], at[odd]
        rules.append(np.stack([chosen // np.uint64(base), chosen % np.uint64(base)], 1).astype(np.uint32))
        symbols[where] = (n + at).astype(np.uint32)
        keep = np.ones(symbols.size, bool)
        keep[where + 1] = False
        last[where] = last[where + 1]
        symbols, last = symbols[keep], last[keep]
        n += chosen.size
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(n, np.uint32)
    for r, (a, b) in enumerate(table_.tolist()):
        lengths[n_base + r] = lengths[a] + lengths[b]
    starts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.uint32)
    return symbols, table_, lengths[n_base:], starts


def pack(ids: np.ndarray, ends: np.ndarray, n_base: int) -> bytes:
    """The shard file of these documents' ids."""
    symbols, rules, lengths, starts = compress(ids, ends, n_base)
    width = 2 if n_base + len(rules) <= 1 << 16 else 4
    head = struct.pack(HEAD, MAGIC, n_base, len(rules), len(ends), symbols.size, width)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, raw: bytes):
        magic, self.n_base, n_rules, self.n_docs, n_symbols, width = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        self.rules = np.frombuffer(raw, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(raw, "<u4", n_rules, at)
        at += 4 * n_rules
        self.starts = np.frombuffer(raw, "<u4", self.n_docs + 1, at)
        at += 4 * (self.n_docs + 1)
        self.symbols = np.frombuffer(raw, f"<u{width}", n_symbols, at)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(symbols.size, np.int64)
        compound = symbols >= self.n_base
        sizes[compound] = self.lengths[symbols[compound].astype(np.int64) - self.n_base]
        return sizes

    def document_lengths(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        total = np.concatenate([[0], np.cumsum(self._sizes(self.symbols))])
        return np.diff(total[self.starts.astype(np.int64)])

    def decode(self, document: int | None = None) -> np.ndarray:
        """The ids of one document, or of all."""
        symbols = self.symbols if document is None else self.symbols[self.starts[document] : self.starts[document + 1]]
        out = symbols.astype(np.uint32)
        while (compound := out >= self.n_base).any():
            sizes = np.where(compound, 2, 1)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            wide = np.empty(int(sizes.sum()), np.uint32)
            wide[at] = out
            pairs = self.rules[out[compound].astype(np.int64) - self.n_base]
            wide[at[compound]] = pairs[:, 0]
            wide[at[compound] + 1] = pairs[:, 1]
            out = wide
        return out


# ---- encoding


#: White space that could join with a neighbour's; wider than the tokenizer's own class, which only sends more texts to it whole.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: A word and one closing mark, which are two pieces for sure.
_MARKED = r"^\p{L}+[.,;:!?)]$"


class Encoder:
    """Whole texts to ids by the tokenizers library.

    A text is cut before single spaces, where this vocabulary's pieces always
    begin, and each distinct unit is encoded by the library once and
    remembered; most words of a corpus are repeats.  A word and a closing mark
    are remembered apart.  The units that a block of texts has new are encoded
    in one call, as one text; as units hold no space, the ids of each are those
    from one that stands for a leading space to the next.  Units that begin or
    end in white space could join with their neighbours there and are encoded
    one by one, and texts in which a cut could meet a run of white space or a
    special token whole.  What is done per word of the corpus are array
    operations only.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.n_base = self.tokenizer.get_vocab_size()
        space = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(self.n_base)])
        self.marks: dict[str, np.ndarray] = {c: self._whole([c])[0] for c in ".,;:!?)"} | {"": np.zeros(0, np.uint32)}
        self._forget()

    def _forget(self) -> None:
        """known: number of a unit; its ids are ids[at[number] : at[number] + size[number]]."""
        self.known: dict[str, int] = {}
        self.ids, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, units: list[str], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        """Remember units whose ids are laid end to end in `ids`."""
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.at = np.append(self.at, self.ids.size + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.ids = np.concatenate([self.ids, *ids])

    def _learn(self, units: pa.Array) -> None:
        """Remember the ids of a space and the unit, for each of these new ones."""
        apart = pc.match_substring_regex(units, f"^{_WHITE}|{_WHITE}$|^$")
        joined, alone = _listed(units.filter(pc.invert(apart))), _listed(units.filter(apart))
        names, ids, sizes = [], [], []
        for a in range(0, len(joined), JOINED):
            part = joined[a : a + JOINED]
            own = self._whole([" " + " ".join(part)])[0]
            begins = np.flatnonzero(self.opens[own])
            if begins.size != len(part) or begins[0]:
                alone += part
                continue
            names += part
            ids.append(own)
            sizes.append(np.diff(np.append(begins, own.size)))
        rest = self._whole([" " + u for u in alone])
        self._add(names + alone, ids + rest, np.concatenate([*sizes, np.array([x.size for x in rest], np.int64)]))

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Numbers of distinct units, new ones being learned."""
        names = _listed(units)
        found = np.array(list(map(self.known.get, names, repeat(-1))), np.int64)
        new = found < 0
        if new.any():
            fresh = units.filter(pa.array(new))
            self._learn(fresh)
            found[new] = list(map(self.known.__getitem__, _listed(fresh)))
        return found

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units end to end, and how many each has."""
        marked = pc.match_substring_regex(units, _MARKED)
        words = pc.if_else(marked, pc.utf8_slice_codeunits(units, 0, -1), units).dictionary_encode()
        word = self._numbers(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(units, -1), "").dictionary_encode()
        mark = marks.indices.to_numpy(zero_copy_only=False)
        # Laid out as word, mark, word, mark, ...; a unit without a mark has an empty one.
        own = [self.marks[c] for c in marks.dictionary.to_pylist()]
        size_m = np.array([m.size for m in own], np.int64)
        at_m = self.ids.size + np.cumsum(size_m) - size_m
        at = np.stack([self.at[word], at_m[mark]], 1).reshape(-1)
        size = np.stack([self.size[word], size_m[mark]], 1).reshape(-1)
        return _laid(np.concatenate([self.ids, *own]), at, size), size[::2] + size[1::2]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these texts (no nulls) end to end, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        hard = pc.match_substring_regex(texts, f"{_WHITE} {_WHITE}|<\\|")
        cut = pc.split_pattern(pc.if_else(hard, "", texts), " ")
        first = cut.offsets.to_numpy()
        units = cut.values.dictionary_encode()
        ids, sizes = self._distinct(units.dictionary)
        codes = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # What a text begins with has no space before it; of texts taken whole that is all.
        heads = self._whole(pc.if_else(hard, texts, cut.values.take(cut.offsets[:-1])).to_pylist())
        codes[first[:-1]] = sizes.size + np.arange(len(heads))
        sizes = np.append(sizes, np.array([h.size for h in heads], np.int64))
        at, size = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.append(0, np.cumsum(size))
        return _laid(np.concatenate([ids, *heads]), at[codes], size), np.diff(ends[first])


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _laid(store: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """store[at : at + size] of each, end to end."""
    begin = np.cumsum(size) - size
    return store[np.repeat(at - begin, size) + np.arange(int(size.sum()))]


def _encoder(vocabulary: str) -> Encoder:
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    kept = worker_cache()
    if ("encoder", path) not in kept:
        kept["encoder", path] = Encoder(path)
    return kept["encoder", path]


def _writer(vocabulary: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("shard", pa.binary())])
        held: list[np.ndarray] = []
        names: list[int | None] = []
        n = before = 0

        def close():
            ends = np.cumsum([len(x) for x in held])
            shard = pack(np.concatenate(held), ends, encoder.n_base)
            columns = [[part], [seq], [before], [n], [names], [shard]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for a, b, _, _ in utf8_slices(batch.column(1), AT_A_TIME):
                ids, sizes = encoder.encode_all(batch.column(1).slice(a, b - a).fill_null(""))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                cuts = np.cumsum(sizes + 1)
                for doc_id, x in zip(batch.column(0).slice(a, b - a).to_pylist(), np.split(ids, cuts[:-1]), strict=True):
                    if held and n + x.size > shard_ids:
                        yield close()
                        seq, before, n, held, names = seq + 1, before + n, 0, [], []
                    held.append(x)
                    names.append(doc_id)
                    n += x.size
        if held:
            yield close()

    return write


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) and write the table of shards to `path`.

    Null texts are empty: their ids are the end id alone.  Null ids come first.
    Rows that share an id are ordered by their text's hash, so that a range of
    one id can still be dealt to several tasks.  An empty table makes no shard.
    """
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    dealt.mapInArrow(_writer(vocabulary, end_id, shard_ids), SHARDS).write.option("compression", "zstd").parquet(path)


def _reader(offsets: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["shard"])
                sizes, ids = shard.document_lengths(), shard.decode()
                at = np.concatenate([[0], np.cumsum(sizes)])
                if at[-1] != ids.size or ids.size != row["n_tokens"]:
                    raise ValueError("a token shard does not expand to its recorded length")
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = at[:-1] + offsets[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return read


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files alone.

    The driver sums up one number for each range of ids (as many as the
    writing job had tasks); no shard is shuffled.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    offsets, n = {}, 0
    for part, size in totals:
        offsets[part] = n
        n += size
    rows = shards.select("part", "before", "n_tokens", "doc_ids", "shard")
    return rows.mapInArrow(_reader(offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the shards of docs, then describe every document as read back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    write_shards(docs, path, **how)
    return read_documents(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents."""
    return encode_corpus(table(spark, sf_dir, "documents"))
