"""Retrieval metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per query: hit, reciprocal rank, nDCG@k, share of distinct sources.

    results: query_id, rank, source; relevant: query_id, source (none for a
    query that must find nothing, which then is a hit).  A source earns its
    gain once, at its first place.
    """
    top = results.filter(F.col("rank") <= k)
    first = top.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    found = first.join(relevant.distinct(), ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    shown = top.groupBy("query_id").agg(F.count("*").alias("shown"), F.countDistinct("source").alias("sources"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    every = queries.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left").join(shown, "query_id", "left")
    nothing = F.col("wanted").isNull()
    empty = F.col("shown").isNull()
    return every.select(
        "query_id",
        F.when(nothing, empty.cast("int")).otherwise(F.col("first").isNotNull().cast("int")).alias("hit"),
        F.when(nothing, empty.cast("double")).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(nothing, empty.cast("double")).otherwise(F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"),
        F.coalesce(F.col("sources") / F.col("shown"), F.lit(1.0)).alias("unique_sources"),
        (nothing & ~empty).cast("int").alias("false_positive"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("hit").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.avg("unique_sources").alias("unique_sources"), F.sum("false_positive").alias("false_positives"))
