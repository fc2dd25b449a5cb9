"""Exact top-k inner-product search by branch and bound over ball trees.

Every shard, a bounded run of vectors, gets a ball tree.  A node with centre c
and radius r holds no vector whose inner product with a query q exceeds
q.c + |q| r; children are visited in the order of that bound, and a node whose
bound is below the query's current kth best score is skipped with all it
holds.  The kth scores live on from shard to shard of a task, and all tasks
start from those of a bounded sample of vectors, found on the driver.

Queries are bounded blocks that are broadcast; the vectors are read once for
each block.  A task sends on k rows for each query of the block; one window
per query picks the best of all tasks.

Components are turned into floor(scale * x); scores are integers, exact in
64-bit floats while products stay below 2**53; rows and queries with components
too large for that, and only they, are scored in Python integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK = 4096
SHARD = 8192
LEAF = 256
#: Vectors whose scores give the first bounds.
SEED_VECTORS = 2048
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), _LONG, np.int64)
        #: What a score must reach to matter, known from elsewhere.
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()

    def kth(self, which: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[which, -1], self.floor[which])

    def offer(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries x vectors) of these vectors; -inf for none."""
        all_scores = np.concatenate([self.score[which], score], 1)
        all_ids = np.concatenate([self.ids[which], np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.score[which] = np.take_along_axis(all_scores, order, 1)
        self.ids[which] = np.take_along_axis(all_ids, order, 1)


class BallTree:
    """Vectors (rows) halved along their widest axis until a node has at most `leaf` of them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self._build(0, len(vectors))
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def _build(self, a: int, b: int) -> int:
        own = self.vectors[self.order[a:b]]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        at = len(self.nodes)
        self.nodes.append(None)
        children = None
        if b - a > self.leaf and radius > 0:
            axis = int(np.argmax(own.max(0) - own.min(0)))
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            children = self._build(a, a + middle), self._build(a + middle, b)
        self.nodes[at] = (a, b, centre, radius * (1 + 1e-9) + 1e-6, children)
        return at

    def search(self, queries: np.ndarray, norms: np.ndarray, own_ids: np.ndarray, best: Best, every: np.ndarray) -> None:
        """Offer the queries numbered `every` what this tree has for them."""

        def bound(node: int, which: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _ = self.nodes[node]
            value = queries[which] @ centre
            return value + norms[which] * radius + 1e-9 * (np.abs(value) + norms[which] * radius)

        def visit(node: int, which: np.ndarray) -> None:
            a, b, _, _, children = self.nodes[node]
            if not which.size:
                return
            if children is None:
                for c in range(a, b, 4 * self.leaf):
                    d = min(b, c + 4 * self.leaf)
                    score = queries[which] @ self.vectors[c:d].T
                    score[own_ids[which, None] == self.ids[None, c:d]] = -np.inf
                    some = (score >= best.kth(which)[:, None]).any(1)
                    if some.any():
                        best.offer(which[some], score[some], self.ids[c:d])
                return
            left, right = children
            on_left, on_right = bound(left, which), bound(right, which)
            ahead = on_left >= on_right
            for first, second, near, far, group in ((left, right, on_left, on_right, ahead), (right, left, on_right, on_left, ~ahead)):
                own = which[group]
                visit(first, own[near[group] >= best.kth(own)])
                visit(second, own[far[group] >= best.kth(own)])

        visit(0, every[bound(0, every) >= best.kth(every)])


def _plain(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, which: np.ndarray, own_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """Scores in Python integers, held within a long: (number, id, score) of the k best of the queries numbered `which`."""
    whole = [[int(x) for x in v] for v in vectors]
    for i in which.tolist():
        q = [int(x) for x in queries[i]]
        scored = ((-max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(q, v, strict=True)))), int(n)) for v, n in zip(whole, ids, strict=True) if n != own_ids[i])
        yield from ((i, n, -s) for s, n in heapq.nsmallest(k, scored))


def _small(rows: np.ndarray) -> np.ndarray:
    """Which rows have components so small that their products with one another are exact in 64-bit floats."""
    return np.abs(rows).max(1, initial=0.0) < (_EXACT / max(1, rows.shape[1])) ** 0.5


def _searcher(block: dict, k: int, shard: int):
    """block: dimension -> (numbers of queries, ids, vectors, floors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(q[0]), k, q[3]) for d, q in block.items()}
        held: dict[int, list] = {d: [] for d in block}
        exact: dict[int, dict[int, list]] = {}

        def search(d: int) -> None:
            if not held[d]:
                return
            ids, vectors = (np.concatenate(x) for x in zip(*held[d], strict=True))
            held[d].clear()
            _, own, queries, _ = block[d]
            fine, fine_queries = _small(vectors), _small(queries)
            every, odd = np.flatnonzero(fine_queries), np.flatnonzero(~fine_queries)
            norms = np.sqrt((queries**2).sum(1))
            for a in range(0, len(ids), shard):
                part = np.flatnonzero(fine[a : a + shard]) + a
                if d and part.size and every.size:
                    BallTree(vectors[part], ids[part]).search(queries, norms, own, best[d], every)
            # Rows and queries with larger components are few: only they are scored one by one.
            large = np.flatnonzero(~fine) if d else np.arange(len(ids))
            found = [_plain(vectors[large], ids[large], queries, np.arange(len(queries)), own, k)] if large.size else []
            if d and odd.size:
                rest = np.flatnonzero(fine)
                found.append(_plain(vectors[rest], ids[rest], queries, odd, own, k))
            for i, n, s in chain(*found):
                kept = exact.setdefault(d, {}).setdefault(i, [])
                kept.append((-s, n))
                kept.sort()
                del kept[k:]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                if d in block:
                    which = np.flatnonzero(sizes == d)
                    held[d].append((ids[which], flat[begin[which][:, None] + np.arange(d)].reshape(which.size, d)))
                    if sum(len(x[0]) for x in held[d]) >= shard:
                        search(d)
        rows: list[tuple[int, int, int]] = []
        for d in block:
            search(d)
            numbers = block[d][0]
            filled = best[d].score > -np.inf
            for i, j in zip(*np.nonzero(filled), strict=True):
                rows.append((int(numbers[i]), int(best[d].ids[i, j]), int(best[d].score[i, j])))
            for i, kept in exact.get(d, {}).items():
                rows += [(int(numbers[i]), n, -s) for s, n in kept]
        number, vec_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())], names=["number", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null, no NaN or infinite component (nor one that overflows when scaled)."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf")))), F.lit(False))


def _block(rows: list, first: int, seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict:
    by_size: dict[int, list] = {}
    for i, r in enumerate(rows):
        by_size.setdefault(len(r.embedding), []).append((first + i, r.vec_id, r.embedding))
    out = {}
    for d, group in by_size.items():
        queries = np.floor(SCALE * np.array([g[2] for g in group], np.float64).reshape(len(group), d))
        own = np.array([g[1] for g in group], np.int64)
        floor = np.full(len(group), -np.inf)
        if d and d in seeds:
            ids, vectors = seeds[d]
            fine, known = _small(queries), _small(vectors)
            if known.sum() > k:
                score = queries[fine] @ vectors[known].T
                score[own[fine, None] == ids[None, known]] = -np.inf
                floor[fine] = np.partition(score, -k, 1)[:, -k]
        out[d] = (np.array([g[0] for g in group]), own, queries, floor)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k best rows of vectors, ties to the smaller vec_id.

    Both have vec_id and embedding (array of numbers).  A query's candidates
    are the rows with another vec_id and as many components; rows that repeat
    an id are candidates of their own, and each query row is answered.  Null
    ids take no part, nor do vectors that aren't `usable`.  Scores beyond a
    long stop at its limits.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    every = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    seeds: dict[int, list] = {}
    for r in every.limit(SEED_VECTORS).collect():
        seeds.setdefault(len(r.embedding), []).append((r.vec_id, r.embedding))
    known = {d: (np.array([x[0] for x in s], np.int64), np.floor(SCALE * np.array([x[1] for x in s], np.float64).reshape(len(s), d))) for d, s in seeds.items()}
    found, held, first, names = None, [], 0, []

    def pass_over(held: list, first: int) -> DataFrame:
        rows = every.mapInArrow(_searcher(_block(held, first, known, k), k, shard), "number long, vec_id long, score long")
        ids = spark.createDataFrame([(first + i, r.vec_id) for i, r in enumerate(held)], "number long, query_id long")
        # At most `block` small rows.
        return rows.join(F.broadcast(ids), "number")

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == block:
            part = pass_over(held, first)
            found = part if found is None else found.unionAll(part)
            held, first = [], first + block
    if held or found is None:
        part = pass_over(held, first)
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every row whose vec_id is divisible by QUERY_STEP against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
