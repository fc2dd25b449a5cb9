"""Language identification with a byte convolutional network.

Filters of several widths run over windows of `WINDOW` bytes, each filter's
maximum goes into a softmax over the languages; the network is trained in numpy
on labelled text.  A whole text is cut into windows end to end; its languages'
log-probabilities are averaged over the windows, weighed by their letters.

Learning reads some `per_language` windows of each language, twice as many at
most, one from each of as many documents, picked by seeded hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .cnn import ConvNet, softmax
from .common import held_out, table, trainable, utf8_slices

WINDOW = 256
PER_LANGUAGE = 1200
#: Windows judged at a time.
BLOCK_WINDOWS = 4096
UNKNOWN = "und"
_SPACE = 32


def _starts(offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, number of the text) of every window: whole texts cut every `width` bytes."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // width))
    text = np.repeat(np.arange(size.size), n)
    return offsets[:-1][text] + width * (np.arange(text.size) - np.repeat(np.cumsum(n) - n, n)), text


def _windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The windows that begin at `start`; beyond the text's end they are spaces."""
    at = start[:, None] + np.arange(width)
    padded = raw if raw.size else np.array([_SPACE], np.uint8)
    return np.where(at < end[:, None], padded[np.minimum(at, padded.size - 1)], np.uint8(_SPACE))


class Model:
    def __init__(self, languages: list[str], windows: list[bytes], labels: list[int]):
        self.languages = languages
        self.net = ConvNet(256, max(1, len(languages)), filters=12)
        if windows and len(languages) > 1:
            x = np.stack([np.frombuffer(w[:WINDOW].ljust(WINDOW), np.uint8) for w in windows])
            self.net.fit(x, np.array(labels), epochs=5)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language's number, score) of each text, in blocks of windows: a very long text takes little more memory than itself."""
        start, text = _starts(offsets)
        letters, log_p = np.empty(text.size), np.empty((text.size, len(self.net.p["c"])), np.float32)
        for a in range(0, text.size, BLOCK_WINDOWS):
            block = slice(a, a + BLOCK_WINDOWS)
            x = _windows(raw, start[block], offsets[1:][text[block]])
            letters[block] = ((x >= 128) | ((x | 32) >= 97) & ((x | 32) <= 122)).sum(1) + 1e-3
            log_p[block] = np.log(np.maximum(softmax(self.net.logits(x)), 1e-9))
        first = np.searchsorted(text, np.arange(offsets.size - 1))
        total = np.add.reduceat(log_p * letters[:, None], first, axis=0) / np.add.reduceat(letters, first)[:, None]
        p = softmax(total)
        best = p.argmax(1)
        return best, p[np.arange(best.size), best]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of trainable rows with a language and a text.

    Two passes over docs: one counts languages, the other fetches a window of
    WINDOW bytes, at a place picked by hash, of the rows whose hash falls below
    the language's rate.
    """
    own = docs.filter(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").count().collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return Model([], [], [])
    rates = {r.lang: min(1.0, per_language / r["count"]) for r in counts}
    rate = F.element_at(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / (1 << 20)
    raw = F.encode("text", "UTF-8")
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.octet_length(raw) - WINDOW + 1)).cast("int") + 1
    rows = own.filter(F.col("lang").isin(languages) & (draw < rate)).select("doc_id", "lang", F.substring(raw, start, F.lit(WINDOW)).alias("w"))
    number = {name: i for i, name in enumerate(languages)}
    held: dict[str, list[tuple[int, int, bytes]]] = {name: [] for name in languages}
    for r in rows.toLocalIterator():
        # Rates make about per_language of each; ids that many rows share could make more.  Which stay doesn't depend on the order of arrival.
        w = bytes(r.w)
        heapq.heappush(held[r.lang], (-xxh64_intdigest(w, 3), r.doc_id, w))
        if len(held[r.lang]) > 2 * per_language:
            heapq.heappop(held[r.lang])
    windows = [(w, number[name]) for name in languages for _, w in sorted(x[1:] for x in held[name])]
    return Model(languages, [w for w, _ in windows], [y for _, y in windows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    `und` with score 0 for null texts and texts without a letter (a character of
    the Unicode category L), and for all if nothing was learned.  Rows are
    judged one by one, whatever their ids.
    """
    raw_model = cloudpickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(raw_model)
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            for a, b, raw, offsets in utf8_slices(batch.column(1), 1 << 19):
                best, score = own.predict(raw, offsets)
                texts = batch.column(1).slice(a, b - a).to_pylist()
                known = [bool(own.languages) and t is not None and letter.search(t) is not None for t in texts]
                names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known, strict=True)]
                scores = [float(s) if ok else 0.0 for s, ok in zip(score.tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents."""
    docs = table(spark, sf_dir, "documents")
    rows = identify(docs, train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
