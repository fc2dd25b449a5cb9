"""Secret scan: fixed patterns, and a character network over every candidate.

The patterns (kinds assign, access, hex) give the base findings.  A candidate
is any run of 16 or more token characters outside them; a convolutional network
in numpy reads it with the text around it, in windows of a fixed number of
characters, as many as its length needs.  Candidates that score above the
threshold are findings of kind cnn.

Findings to learn from are the base findings of a bounded sample of documents
(with what introduces them hidden in half the cases, so that the value itself
has to speak) and invented tokens of public formats; the other side is the
sample's remaining candidates and invented identifiers.  Scores are calibrated
by a logistic fit on a part held back; the threshold is the highest at which
recall on another part is at least RECALL, and recall and false findings are
measured on a third.

The scan reads every text once and writes one row per document, with its
candidates and their surroundings, to the shared folder; the network then reads
only these.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cnn import ConvNet
from .common import materialize, table

# Fixed patterns of the base findings.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE = 24, 40
RECALL = 0.98
#: Findings and candidates fetched for learning, each.
SAMPLE = 1500


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of token characters that no base finding touches."""
    by_start = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b)  # findings that begin before it ends
        if not k or reach[k - 1] <= a:
            out.append((a, b))
    return out


def view(text: str, start: int, end: int) -> list[str]:
    """The windows of a candidate: BEFORE characters around its beginning, then INSIDE of it at a time."""
    return [text[max(0, a - BEFORE) : a].rjust(BEFORE) + text[a : a + INSIDE].ljust(INSIDE) for a in range(start, end, INSIDE)]


def _coded(windows: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), BEFORE + INSIDE)
    return np.where(raw < 128, raw, 127).astype(np.uint8)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(a, 512) for a in range(0, batch.num_rows, 512)):
            found, seen = [], []
            for x in part.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                found.append([{"kind": k, "start": a, "end": b, "windows": view(text, a, b)[:1]} for k, a, b in base])
                seen.append([{"start": a, "end": b, "windows": view(text, a, b)} for a, b in candidates(text, base)])
            windows = ("windows", pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(found, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), windows]))),
                    pa.array(seen, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), windows]))),
                ],
                names=["doc_id", "base", "candidates"],
            )


SCANNED = "doc_id long, base array<struct<kind:int,start:int,end:int,windows:array<string>>>, candidates array<struct<start:int,end:int,windows:array<string>>>"


def _invented(rng: random.Random, n: int) -> tuple[list[str], list[str]]:
    """Windows of invented secrets in public formats, and of invented harmless identifiers."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = "the data user order config list value index table update model remote local config session request handler default service result buffer stream".split()
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    good, bad = [], []
    for _ in range(n):
        before = rng.choice(["", " ".join(rng.choice(parts) for _ in range(4)) + " ", 'key = "', "Authorization: Bearer ", "\n"])
        value = rng.choice([lambda: "ghp_" + pick(alnum, 36), lambda: pick(alnum + "+/", 40), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24), lambda: pick("0123456789ABCDEF", 32), lambda: "eyJ" + pick(alnum + "-_", 60), lambda: pick(alnum, rng.randint(20, 48))])()
        good.append(view(before + value + " ", len(before), len(before) + len(value))[0])
        name = rng.choice([lambda: "_".join(rng.choice(parts) for _ in range(4)), lambda: "".join(rng.choice(parts).title() for _ in range(4)), lambda: "-".join(rng.choice(parts) for _ in range(4)), lambda: "/" + "/".join(rng.choice(parts) for _ in range(4)), lambda: rng.choice("=-_") * rng.randint(16, 60), lambda: "".join(rng.choice(parts) for _ in range(4))])()
        bad.append(view(before + name + " ", len(before), len(before) + len(name))[0])
    return good, bad


class Model:
    """Network, calibration and threshold."""

    def __init__(self, findings: list[str], others: list[str], seed: int = 13):
        rng = random.Random(seed)
        good, bad = _invented(rng, 800)
        findings = [w if i % 2 else " " * BEFORE + w[BEFORE:] for i, w in enumerate(findings)]
        x = _coded([*findings, *good, *others, *bad])
        y = np.concatenate([np.ones(len(findings) + len(good), np.int64), np.zeros(len(others) + len(bad), np.int64)])
        order = np.random.default_rng(seed).permutation(len(x))
        # Parts of their own for learning, for calibration, for the threshold, and for measuring what that gives.
        learn, fit, choose, measure = np.split(order, [len(x) * 6 // 10, len(x) * 7 // 10, len(x) * 85 // 100])
        self.net = ConvNet(128, 2, widths=(3, 5), filters=12)
        self.net.fit(x[learn], y[learn], epochs=6)
        z = self.net.logits(x[fit])
        self.fit = self._logistic(z[:, 1] - z[:, 0], y[fit])
        p = np.sort(self.probability(x[choose][y[choose] == 1]))
        #: The highest threshold that keeps RECALL of the findings of its part.
        self.threshold = float(p[int((1 - RECALL) * p.size)]) if p.size else 1.0
        #: Share of findings over the threshold, and of others, on the part that nothing was fitted to.
        over, own = self.probability(x[measure]) >= self.threshold, y[measure] == 1
        self.recall, self.false = (float(over[which].mean()) if which.any() else 0.0 for which in (own, ~own))

    @staticmethod
    def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, w = np.column_stack([z, np.ones_like(z)]).astype(float), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (y - p) - 0.05 * (w - [1.0, 0.0]))
        return float(w[0]), float(w[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.net.logits(x)
        return 1 / (1 + np.exp(-np.clip(self.fit[0] * (z[:, 1] - z[:, 0]) + self.fit[1], -30, 30)))


def train(scanned: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` base findings and `sample` other candidates, those with the least seeded hash."""
    picked = []
    for column in ("base", "candidates"):
        rows = scanned.select("doc_id", F.explode(column).alias("s")).select(F.element_at("s.windows", 1).alias("w"), F.xxhash64("s.windows", F.lit("sample")).alias("h"))
        picked.append(sorted(r.w for r in rows.distinct().orderBy("h", "w").limit(sample).collect()))
    return Model(*picked)


def _judge(raw_model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(raw_model)
        for batch in batches:
            rows = batch.to_pylist()
            windows = [w for r in rows for c in r["candidates"] for w in c["windows"]]
            counts = [len(c["windows"]) for r in rows for c in r["candidates"]]
            kept = np.zeros(len(counts), bool)
            if windows:
                over = np.concatenate([model.probability(_coded(windows[a : a + 4096])) for a in range(0, len(windows), 4096)]) >= model.threshold
                kept = np.logical_or.reduceat(over, np.cumsum(counts) - counts)
            at, out = 0, []
            for r in rows:
                base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
                more = [(c["start"], 3, c["end"]) for i, c in enumerate(r["candidates"]) if kept[at + i]]
                at += len(r["candidates"])
                text = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(x)) for x in (base, base + more)]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((r["doc_id"], *n, hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text).

    Offsets count code points, ends are exclusive; spans are kind:start:end by
    start, then kind.  Null texts are empty and have no spans; rows are scanned
    one by one, so repeated and null ids are no matter.
    """
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, SCANNED), "secrets")
    model = model or train(scanned)
    return scanned.mapInArrow(_judge(cloudpickle.dumps(model)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    return scan(table(spark, sf_dir, "documents"))
