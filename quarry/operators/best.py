"""The best chunks of every query by BM25, without a row for every match.

A query matches a large part of the corpus, and only a few chunks are ever
shown.  So the corpus is reduced to one row for each chunk, with its length and
what it has of the queries' terms; each task scores its chunks and keeps those
that can still be among the best k of their query; contents are joined to these
alone.  All chunks are scored and ranks are exact: a phrase raises a score by
PHRASE_BOOST at most, so nothing that could reach the kth score is let go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SearchLimits
from quarry.functions import text as T
from quarry.operators import search
from quarry.operators.index import Index, weighted_terms
from quarry.operators.store import written

#: Gains added at once, and pairs held before those that can't be among the best are let go.
GAINS = 1 << 19
#: Ranks that the selection reads first; queries that need more are read again with FURTHER times as many.
FIRST_RANKS = 32
FURTHER = 8

_PAIR = pa.schema([("q", pa.int32()), ("chunk_no", pa.int64()), ("base", pa.float64())])


@dataclass(frozen=True)
class Matches:
    """What chunks have of the queries' terms.

    rows: chunk_no, length, hits (number of a term, tf), for every chunk with
    terms.  asked, on the driver: query_id, term, weight, idf, term_rank.
    """

    chunks: DataFrame
    rows: DataFrame
    queries: DataFrame
    names: list[str]
    asked: pd.DataFrame
    average: float


def numbered(chunks: DataFrame, purpose: str = "chunks") -> DataFrame:
    """chunks, written, with chunk_no: any unique number, as positions would deal contents out once more."""
    return written(chunks.withColumn("chunk_no", F.monotonically_increasing_id()), purpose)


def match(chunks: DataFrame, queries: DataFrame) -> Matches:
    """chunks (numbered) reduced to the terms of queries (query_id, query); the terms go through the driver."""
    spark = chunks.sparkSession
    names = sorted(r.term for r in search.query_terms(queries).select("term").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, term string")
    # Terms that no query has only add to the length; they are one group.
    found = weighted_terms(chunks, "chunk_no").join(F.broadcast(numbers), "term", "left")
    counted = found.groupBy("chunk_no", F.coalesce("number", F.lit(-1)).alias("number")).agg(F.sum("w").alias("tf"))
    hits = F.collect_list(F.when(F.col("number") >= 0, F.struct("number", "tf"))).alias("hits")
    rows = written(counted.groupBy("chunk_no").agg(F.sum("tf").alias("length"), hits), "matches")
    n, total = chunks.count(), rows.agg(F.sum("length")).first()[0] or 0.0
    df = rows.select(F.explode("hits.number").alias("number")).groupBy("number").count().collect()
    terms = spark.createDataFrame([(names[r.number], r["count"]) for r in df], "term string, df long")
    # The gates read n and df of an index and nothing else.
    chosen = search.selected_terms(queries, Index(chunks, rows, terms, rows, rows, n, total / n if n else 0.0))
    asked = chosen.select(F.col("query_id").cast("string"), "term", "weight", search.idf(F.col("df"), n, "bm25").alias("idf"), "term_rank").toPandas()
    return Matches(chunks, rows, queries.withColumn("query_id", F.col("query_id").cast("string")), names, asked, total / n if n else 0.0)


class _Scorer:
    """Scores of chunks for many queries, as arrays: base is what a chunk has without a phrase."""

    def __init__(self, terms: np.ndarray, queries: np.ndarray, parts: np.ndarray, scale: np.ndarray, n_terms: int, average: float, k: int):
        order = np.argsort(terms, kind="stable")
        self.q, self.part = queries[order], parts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.scale, self.average, self.k = scale, average or 1.0, k
        self.least = np.zeros(len(scale))

    def pairs(self, numbers: np.ndarray, tf: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, base) of each pair that matches; hits are listed row by row, sizes of them a row."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        part = tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length[row] / self.average))
        times = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(times)
        # Cut between rows, at GAINS gains or after one row.
        after = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(after, after[first] + GAINS, "right")) - 1)
            a, b = np.searchsorted(row, [first, last])
            hit = np.repeat(np.arange(a, b), times[a:b])
            at = self.starts[numbers[hit]] + np.arange(len(hit)) - (ends[hit] - times[hit] - after[first])
            gain = self.part[at] * part[hit]
            pair = self.q[at].astype(np.int64) * (last - first) + row[hit] - first
            # In the order of their sizes, so that equal gains have equal sums whichever terms they are of.
            order = np.lexsort((gain, pair))
            each, group = np.unique(pair[order], return_inverse=True)
            q = each // (last - first)
            yield q, each % (last - first) + first, np.bincount(group, gain[order], len(each)) / self.scale[q]
            first = last

    def able(self, q: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Which can reach the kth score of their query, as far as known."""
        return (base > 0) & (np.minimum(1.0, base * search.PHRASE_BOOST) >= np.minimum(1.0, self.least[q]))

    def learn(self, q: np.ndarray, base: np.ndarray) -> None:
        order = np.lexsort((-base, q))
        kth = np.searchsorted(q[order], np.arange(len(self.least))) + self.k - 1
        there = kth < np.searchsorted(q[order], np.arange(len(self.least)), "right")
        self.least[there] = np.maximum(self.least[there], base[order][kth[there]])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        fresh = 0
        for batch in batches:
            hits, no = batch.column("hits"), batch.column("chunk_no").to_numpy()
            flat = hits.flatten()
            arrays = (flat.field("number").to_numpy(), flat.field("tf").to_numpy(), hits.value_lengths().to_numpy(), batch.column("length").to_numpy())
            for q, row, base in self.pairs(*arrays):
                able = self.able(q, base)
                kept = [np.concatenate([old, new[able]]) for old, new in zip(kept, (q, no[row], base), strict=True)]
                fresh += int(able.sum())
                if fresh > max(4096, len(kept[0]) // 2):
                    self.learn(kept[0], kept[2])
                    able = self.able(kept[0], kept[2])
                    kept, fresh = [x[able] for x in kept], 0
        self.learn(kept[0], kept[2])
        able = self.able(kept[0], kept[2])
        q, no, base = (x[able] for x in kept)
        for a in range(0, len(q), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 65_536].astype(np.int32)), pa.array(no[a : a + 65_536]), pa.array(base[a : a + 65_536])], schema=_PAIR)


def best(matches: Matches, k: int, prefix: str | None = None, only: set[str] | None = None) -> DataFrame:
    """The columns of `search.score` but for chunk_pos, of the best k chunks of each query (of those in `only`)."""
    spark, asked = matches.chunks.sparkSession, matches.asked
    asked = asked[asked.query_id.isin(only)] if only is not None else asked
    ids, q = np.unique(asked.query_id.to_numpy(dtype=str), return_inverse=True)
    by_rank = np.lexsort((asked.term_rank.to_numpy(), q))
    part = (asked.weight * asked.idf).to_numpy(dtype=float)[by_rank]
    q = q[by_rank]
    terms = np.searchsorted(np.array(matches.names, dtype=object), asked.term.to_numpy()[by_rank]) if len(asked) else np.zeros(0, np.int64)
    scorer = _Scorer(terms, q, part, np.bincount(q, part * (search.K1 + 1), len(ids)), len(matches.names), matches.average, k)
    rows = matches.rows
    if prefix:
        rows = rows.join(matches.chunks.filter(F.startswith("source", F.lit(prefix))).select("chunk_no"), "chunk_no", "left_semi")
    pairs = written(rows.mapInArrow(scorer.run, "q int, chunk_no long, base double"), "pairs")
    kth = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("base")))).filter(F.col("_n") == k).select("q", F.col("base").alias("_kth"))
    able = F.least(F.lit(1.0), F.col("base") * search.PHRASE_BOOST) >= F.least(F.lit(1.0), F.coalesce("_kth", F.lit(0.0)))
    admitted = pairs.join(kth, "q", "left").filter(able).drop("_kth")
    names = spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "q int, query_id string")
    worded = names.join(matches.queries, "query_id").select("q", "query_id", F.lower(T.strip(F.col("query"))).alias("_phrase"))
    full = matches.chunks.join(search._bounded(admitted), "chunk_no").join(search._bounded(worded), "q")
    boost = F.when((F.length("_phrase") > 2) & F.contains(F.lower("content"), F.col("_phrase")), search.PHRASE_BOOST).otherwise(1.0)
    scored = full.withColumn("score", F.least(F.lit(1.0), F.col("base") * boost))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "source", "ord")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "source", "section_path", "start_line", "end_line", "content", "score")


def select_results(matches: Matches, limit: int = 5, limits: SearchLimits = SearchLimits(), first: int = FIRST_RANKS) -> DataFrame:
    """`search.select_results` over every match, with as many ranks read as each query's selection goes through."""
    most, schema = min(limit, limits.max_results), search.RESULT + ", _done boolean"

    def fold(k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (r | {"section_path": list(r["section_path"])} for batch in batches for r in batch.to_dict("records"))
            for query_id, own in groupby(rows, lambda r: r["query_id"]):
                own = list(own)
                results, ended, _ = search.select(own, most, limits)
                done = ended or len(results) >= most or len(own) < k
                out = [{"query_id": query_id, "rank": i + 1, **r, "_done": done} for i, r in enumerate(results)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return run

    out, only, k = None, None, first
    while only is None or only:
        able = best(matches, k, only=only).filter(F.col("score") >= limits.min_score)
        chosen = written(able.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInPandas(fold(k), schema), "selected")
        only = {r.query_id for r in chosen.filter("NOT _done").select("query_id").distinct().collect()}
        chosen = chosen.filter("_done").drop("_done")
        out, k = chosen if out is None else out.unionByName(chosen), k * FURTHER
    return out
