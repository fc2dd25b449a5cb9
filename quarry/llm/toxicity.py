"""Toxicity by compression distance.

zstandard dictionaries are trained on the windows of ordinary text, which both
sides share, on what is toxic documents' own, and on what is ordinary
documents' own.  A window of words that compresses better with the toxic
dictionary than with the ordinary one speaks for toxicity: the bytes saved,
over the whole text, in its best window and in its three best, are calibrated
to a probability by a logistic fit on labelled documents that the dictionaries
haven't seen (FOLDS folds, each with dictionaries of the others).

Samples for a class's own dictionary are its documents, less the words that
aren't at least `ratio` times as frequent there as in the other class; the
trainer picks from them.  The same folds decide on the ratio.

The fit uses at most `per_class` labelled documents of each class, whole;
scoring reads whole texts, window by window, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import math
import random
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, trainable

#: Labelled documents of either class to learn from.
PER_CLASS = 2400
#: Words in a window.
WINDOW = 16
THRESHOLD = 0.3
#: Bytes of the dictionary that both sides share and of the one that either has for itself, and of the segments they are built of.
SHARED_BYTES, OWN_BYTES = 16_000, 700
SHARED_SEGMENT, OWN_SEGMENT = 16, 10
#: Windows of ordinary text that the shared dictionary is trained on, and of one document.
MOST_WINDOWS, WINDOWS_EACH = 20_000, 60
#: How many times as frequent as in the other class a word of a class's own samples is; the folds decide which.
RATIOS = (4.0, 8.0, 32.0)
FOLDS = 4
#: Pull of the calibration's weights to zero.
RIDGE = 0.5
_SOFT = 100.0
_SPACES = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def windows(text: bytes, words: int = WINDOW) -> Iterator[bytes]:
    """Lower-case words of the whole text, `words` at a time, between single spaces; at least one window."""
    own = text.lower().translate(_SPACES).split()
    for a in range(0, max(1, len(own)), words):
        yield b" " + b" ".join(own[a : a + words]) + b" "


#: What stands between a trained dictionary's entropy tables and its content: the offsets 1, 4 and 8.
_OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary of these samples: at most `size` bytes, in segments of about `segment`.

    Samples that fit in as they are, or are too few for the trainer, are the dictionary themselves.
    """
    import zstandard as z

    whole = b"".join(sorted(set(samples)))
    if len(whole) <= size:
        return whole
    try:
        # The entropy tables are left out: they are of windows, not of words, and weigh on every literal.
        return z.train_dictionary(size + 400, samples, k=segment, d=6, steps=1).as_bytes().rpartition(_OFFSETS)[2][-size:]
    except z.ZstdError:
        return whole[:size]


class Model:
    """Dictionaries and calibration.  `learned` is False where there were too few labels: all scores are the same then."""

    def __init__(self, toxic: list[list[bytes]], ordinary: list[list[bytes]]):
        """toxic, ordinary: texts in folds.  Each fold is calibrated with dictionaries of the others; those that stay are of all.

        The ratio is the one of RATIOS at which folds that neither the
        dictionaries nor the calibration have seen come out most probable.
        """
        every = range(len(toxic))
        self.learned = min(sum(map(len, toxic)), sum(map(len, ordinary))) >= len(toxic)
        self.dictionaries, self.ratio, self.weights = (b"", b""), RATIOS[0], self._calibrate(np.zeros((0, 3)), np.zeros(0))
        if not self.learned:
            warnings.warn("toxicity: too few labelled documents to learn from; all texts get the same score", stacklevel=2)
            return
        words = [[[sorted(set(x.lower().translate(_SPACES).split())) for x in fold] for fold in c] for c in (toxic, ordinary)]
        count = [[Counter(w for d in fold for w in d) for fold in c] for c in words]

        def learn(folds: list[int], ratio: float, shared: bytes) -> tuple[bytes, bytes]:
            n = [sum((c[k] for k in folds), Counter()) for c in count]
            size = [max(1, sum(len(c[k]) for k in folds)) for c in words]
            own = []
            for c, o in ((0, 1), (1, 0)):
                # One more of each, so that a word of a single document isn't typical of its class.
                typical = {w for w, k in n[c].items() if k + 1 >= ratio * (n[o].get(w, 0) * size[c] / size[o] + 1)}
                samples = [b" " + b" ".join(kept) + b" " for k in folds for d in words[c][k] if (kept := [w for w in d if w in typical])]
                own.append(trained(samples, OWN_BYTES, OWN_SEGMENT))
            return tuple(shared + x.ljust(max(map(len, own))) for x in own)

        def shared(folds: list[int]) -> bytes:
            dice = random.Random(17)
            each = [dice.sample(w, min(len(w), WINDOWS_EACH)) for k in folds for x in ordinary[k] for w in [list(windows(x))]]
            flat = [w for d in each for w in d]
            return trained(dice.sample(flat, min(len(flat), MOST_WINDOWS)), SHARED_BYTES, SHARED_SEGMENT)

        others = [[i for i in every if i != k] for k in every]
        bases = [shared(f) for f in others]
        best = math.inf
        for ratio in RATIOS:
            parts = []
            for k in every:
                self.dictionaries = learn(others[k], ratio, bases[k])
                pair = self.compressors()
                x = [self.features(t, *pair) for t in (*toxic[k], *ordinary[k])]
                parts.append((np.array(x, np.float64).reshape(-1, 3), np.repeat([1.0, 0.0], [len(toxic[k]), len(ordinary[k])])))
            loss = self._loss(parts)
            if loss < best:
                best, self.ratio = loss, ratio
                self.weights = self._calibrate(*map(np.concatenate, zip(*parts)))
        self.dictionaries = learn(list(every), self.ratio, shared(list(every)))

    def _loss(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> float:
        """Log loss of every part under the calibration on the others."""
        loss = 0.0
        for k, (x, y) in enumerate(parts):
            w = self._calibrate(*map(np.concatenate, zip(*(p for i, p in enumerate(parts) if i != k))))
            z = np.clip(self._expand(x) @ w, -30, 30)
            loss += float((np.logaddexp(0, z) - y * z).sum())
        return loss

    def compressors(self):
        """compress functions of the toxic and the ordinary dictionary; frames carry nothing but the data."""
        import zstandard as z

        out = []
        for content in self.dictionaries:
            if len(content) < 8:  # nothing was learned
                content = content.ljust(8)
            how = z.ZstdCompressionParameters.from_level(
                3, source_size=256, dict_size=len(content), format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
                strategy=z.STRATEGY_BTOPT, min_match=3, search_log=4, window_log=16, hash_log=14, chain_log=14,
            )
            out.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress)
        return out

    @staticmethod
    def features(text: bytes, toxic, ordinary) -> tuple[float, float, float]:
        """Bytes saved per byte in the whole text, bytes saved in its best window, and in its three best."""
        gains, size = [], 0
        for w in windows(text):
            gains.append(len(ordinary(w)) - len(toxic(w)))
            size += len(w)
        top = heapq.nlargest(3, gains)
        return sum(gains) / (size + _SOFT), float(top[0]), float(sum(top))

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.array([-1.0, 0.0, 0.0, 0.0, 0.0])
        a = self._expand(x)
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(a.shape[1]), a.T @ (y - p) - RIDGE * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        return w

    @staticmethod
    def _expand(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), 100 * x[:, 0], x[:, 1] / 4, x[:, 2] / 8, 5 * np.maximum(0, x[:, :2]).prod(1) ** 0.5])

    def shift(self, log_odds: float) -> None:
        self.weights[0] += log_odds

    def scorer(self):
        pair = self.compressors()

        def score(text: bytes) -> float:
            z = float((self._expand(np.array([self.features(text, *pair)])) @ self.weights)[0])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample: of each class at most `per_class` labelled documents, those with the least seeded hash.

    Only rows for which `trainable` holds are learned from.  Labels other than
    0 and 1, null ids and ids with contradicting labels teach nothing.  Texts
    are fetched by a join against the sample's ids, whose number is bounded.
    """
    spark = docs.sparkSession
    known = labels.filter(trainable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").select("doc_id", "toxic")
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = []
    for kind in (0, 1):
        chosen += known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    sample = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "_id long, _toxic int")
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_toxic", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    texts: dict[int, tuple[int, bytes]] = {}
    for r in rows.toLocalIterator():
        raw = bytes(r.raw)
        if r._id not in texts or raw < texts[r._id][1]:
            texts[r._id] = (r._toxic, raw)
    sets: dict[tuple[int, int], list[bytes]] = {(k, h): [] for k in (0, 1) for h in range(FOLDS)}
    # Copies of one text must not stand on both sides: the text decides its side, and counts once.
    seen = set()
    from xxhash import xxh64_intdigest

    for _, (kind, raw) in sorted(texts.items()):
        name = xxh64_intdigest(raw, 11)
        if (kind, name) not in seen:
            seen.add((kind, name))
            sets[kind, name % FOLDS].append(raw)
    model = Model(*([sets[k, h] for h in range(FOLDS)] for k in (1, 0)))
    found = [sum(len(sets[k, h]) for h in range(FOLDS)) for k in (0, 1)]
    if min(found) and len(totals) == 2:
        # Classes are sampled at rates of their own; the calibration is for the odds that all labels have.
        sampled = math.log(found[1] / found[0])
        model.shift(math.log(totals[1] / totals[0]) - sampled)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "_quarry_score") -> DataFrame:
    """The columns `keep` (all) of docs with `name`: the probability that a text is toxic, from all of the text.

    Null and empty texts have one window without words.  Every row is scored by
    itself, so repeated and null ids don't matter; an empty table stays empty.
    """
    raw = cloudpickle.dumps(model)
    keep = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(raw).scorer()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            scores = pa.array([own(x.as_py() or b"") for x in text], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), scores], names=[*keep, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])
    return docs.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more, columns as they were, whatever their names."""
    name = "_quarry_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name=name).filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, learned from `labels` but for the held-out rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quarry_score").alias("score"), (F.col("_quarry_score") >= THRESHOLD).cast("int").alias("predicted"))
