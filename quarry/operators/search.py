"""Batch search: a DataFrame of queries against an index, in one plan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SearchLimits
from quarry.functions import text as T
from quarry.operators.chunking import collapse, strip, units16
from quarry.operators.index import Index

# Fixed values of the ranking.
K1 = 1.2
B = 0.75
COMPOUND_WEIGHT = 2.0
PHRASE_BOOST = 1.25
SELECTIVE = 0.4
NON_SELECTIVE = 0.6
GATED_FROM = 10
#: Query terms are broadcast up to this many rows; beyond, the join is Spark's choice.
BROADCAST_TERMS = 2_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight, ord: summed weights, and where a term first stands."""
    each = queries.select("query_id", F.posexplode(T.tokenize(F.col("query"))).alias("at", "term"))
    weight = F.sum(F.when(T.is_compound(F.col("term")), COMPOUND_WEIGHT).otherwise(1.0))
    return each.groupBy("query_id", "term").agg(weight.alias("weight"), F.min("at").alias("ord")).filter(~F.col("term").isin(*T.STOP_WORDS))


def selected_terms(queries: DataFrame, index: Index) -> DataFrame:
    """Query terms that are looked up, rarest first (term_rank), after the gates.

    From GATED_FROM chunks on, a query needs a term in at most SELECTIVE of
    them, and terms in more than NON_SELECTIVE are left out.
    """
    known = query_terms(queries).join(index.terms, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    share = F.col("df") / F.lit(max(1, index.n))
    if index.n >= GATED_FROM:
        by_query = Window.partitionBy("query_id")
        known = known.withColumn("_able", F.max(((F.col("df") > 0) & (share <= SELECTIVE)).cast("int")).over(by_query)).filter("_able = 1").filter(share <= NON_SELECTIVE).drop("_able")
    order = Window.partitionBy("query_id").orderBy("df", "ord")
    return known.filter("df > 0").withColumn("term_rank", F.row_number().over(order))


def idf(df: Column, n: int, algorithm: str) -> Column:
    if algorithm == "bm25":
        return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return F.log((F.lit(float(n)) + 1) / (df + 1)) + 1


def _bounded(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def score(queries: DataFrame, index: Index, limits: SearchLimits = SearchLimits(), prefix: str | None = None) -> DataFrame:
    """query_id, chunk_pos, id, source, score, rank: candidates, best first.

    Candidates are the first `max_candidates` chunks by term rank and position;
    terms that come later still add to those.  None admits every match.
    """
    n, algorithm = index.n, limits.algorithm
    terms = selected_terms(queries, index).withColumn("idf", idf(F.col("df"), n, algorithm))
    part = F.col("weight") * F.col("idf")
    scale = terms.groupBy("query_id").agg((F.sqrt(F.sum(part * part)) if algorithm == "tfidf" else F.sum(part * (K1 + 1))).alias("scale"))
    hits = index.postings.join(_bounded(terms.select("query_id", "term", "weight", "idf", "term_rank")), "term")
    if prefix:
        hits = hits.join(index.chunks.filter(F.startswith(F.col("source"), F.lit(prefix))).select("chunk_pos"), "chunk_pos", "left_semi")
    # Norms take two shuffles of all postings: BM25 goes without.
    hits = hits.join(index.stats if algorithm == "tfidf" else index.sized.withColumn("norm", F.lit(1.0)), "chunk_pos")
    if algorithm == "bm25":
        gain = part * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (index.average or 1.0))))
    else:
        gain = part * F.col("tf") * F.col("idf")
    # Gains are added in the order of their sizes: equal gains have equal sums, however rows were dealt; there are as many as a query has terms.
    raw = F.aggregate(F.array_sort(F.collect_list(gain)), F.lit(0.0), lambda total, g: total + g)
    by_chunk = hits.groupBy("query_id", "chunk_pos").agg(raw.alias("raw"), F.min(F.struct("term_rank", "chunk_pos")).alias("first"), F.first("norm").alias("norm"))
    admitted = by_chunk
    if limits.max_candidates is not None:
        admitted = by_chunk.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).filter(F.col("_n") <= limits.max_candidates)
    phrase = F.lower(T.strip(F.col("query")))
    base = F.col("raw") / F.col("scale") / (F.col("norm") if algorithm == "tfidf" else F.lit(1.0))
    boost = F.when((F.length(phrase) > 2) & F.contains(F.lower("content"), phrase), PHRASE_BOOST).otherwise(1.0)
    full = admitted.join(scale, "query_id").join(index.chunks, "chunk_pos").join(_bounded(queries.select("query_id", "query")), "query_id")
    ranked = full.withColumn("score", F.least(F.lit(1.0), base * boost)).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "first")
    return ranked.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "chunk_pos", "id", "source", "section_path", "start_line", "end_line", "content", "score")


def fingerprint(content: str) -> str:
    return hashlib.sha256(collapse(content.lower())[:400].encode("utf-8", "surrogatepass")).hexdigest()


def merged_id(source: str, path: list, start: int, end: int, content: str) -> str:
    body = json.dumps({"source": source, "sectionPath": path, "startLine": start, "endLine": end, "content": content}, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(b"quarry-merged\0" + body.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _merge(last: dict, match: dict, limits: SearchLimits) -> dict | None:
    """The last result grown by a chunk whose lines touch it, if both are whole, of one section, and short enough together."""
    spans = sorted([(last["start_line"], last["end_line"], last["content"]), (match["start_line"], match["end_line"], match["content"])], key=lambda s: s[0])
    (start, middle, _), (after, end, _) = spans
    touching = 1 <= start <= middle and middle + 1 == after <= end
    same = all(last[k] == match[k] for k in ("source", "section_path")) and not (last["truncated"] or match.get("truncated"))
    content = "\n".join(s[2] for s in spans)
    if not (touching and same and units16(content) <= limits.max_content_chars):
        return None
    return last | {"id": merged_id(last["source"], last["section_path"], start, end, content), "start_line": start, "end_line": end, "content": content}


def select(matches: Iterable[dict], limit: int, limits: SearchLimits = SearchLimits()) -> tuple[list[dict], bool, set[str]]:
    """Results of one query from its matches, best first: (results, truncated, warnings).

    A fold in which every rule sees what the ones before it did: number of
    results, score floor, results per source, near-equal contents, merging with
    the last result, clipping, and the budget of characters.
    """
    results: list[dict] = []
    warnings: set[str] = set()
    per_source: dict[str, int] = {}
    seen: set[str] = set()
    left, truncated = limits.max_total_chars, False
    matches = iter(matches)
    first = list(islice(matches, 1))
    floor = max(limits.min_score, (first[0]["score"] if first else 0.0) * limits.relative_cutoff)
    for match in chain(first, matches):
        if len(results) >= limit or match["score"] < floor:
            truncated = True
            break
        if per_source.get(match["source"], 0) >= limits.max_per_source or (key := fingerprint(match["content"])) in seen:
            continue
        grown = _merge(results[-1], match, limits) if results else None
        if grown and (more := units16(grown["content"]) - units16(results[-1]["content"])) <= left:
            results[-1] = grown | {"score": max(results[-1]["score"], round(match["score"], 4))}
            left -= more
            seen |= {key, fingerprint(grown["content"])}
            continue
        content, cut = match["content"], bool(match.get("truncated"))
        if cut:
            warnings.add("document_truncated")
        if units16(content) > limits.max_content_chars:
            content, cut = content[: limits.max_content_chars], True
            warnings.add("content_truncated")
        if units16(content) > left:
            content, cut, truncated = content[: max(0, left)], True, True
            if not strip(content):
                break
        left -= units16(content)
        seen.add(key)
        per_source[match["source"]] = per_source.get(match["source"], 0) + 1
        results.append({k: match[k] for k in ("id", "source", "section_path", "start_line", "end_line")} | {"content": content, "score": round(match["score"], 4), "truncated": cut})
        if left <= 0:
            truncated = True
            break
    if truncated:
        warnings.add("results_truncated")
    return results, truncated, warnings


RESULT = "query_id string, rank int, id string, source string, section_path array<string>, start_line int, end_line int, content string, score double, truncated boolean"


def select_results(scored: DataFrame, limit: int = 5, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """The selection for every query, read in the order of ranks and only as far as it goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r | {"section_path": list(r["section_path"])} for batch in batches for r in batch.to_dict("records"))
        for query_id, matches in groupby(rows, lambda r: r["query_id"]):
            results, _, _ = select(matches, min(limit, limits.max_results), limits)
            out = [{"query_id": query_id, "rank": i + 1, **r} for i, r in enumerate(results)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    # Nothing below the least score is ever a result.
    able = scored.withColumn("query_id", F.col("query_id").cast("string")).filter(F.col("score") >= limits.min_score)
    return able.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInPandas(run, RESULT)


def evidence(scored: DataFrame, queries: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """query_id, candidates, best, status: ok, or no_match if nothing reaches the least score."""
    own = scored.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("score").alias("best"))
    every = queries.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("best", F.lit(0.0)).alias("best"))
    return every.withColumn("status", F.when(F.col("best") >= limits.min_score, "ok").otherwise("no_match"))


def clipped(scored: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """Contents cut to the longest allowed, with a flag."""
    return scored.withColumn("truncated", F.length("content") > limits.max_content_chars).withColumn("content", F.substring("content", 1, limits.max_content_chars))


