"""Admission of documents: caps, budgets and duplicates, in a serial, deterministic order.

A budget that stops at its first overflow is a running sum.  The sums are taken
per range of ids and carried over from range to range by a small table, so no
window spans the whole corpus in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

MEMORY_BASE = 256


#: Keys that the bounds of ranges are picked from.
SAMPLED_KEYS = 8_192


def range_number(rows: DataFrame, order: list[str], ranges: int) -> Column:
    """Which of at most `ranges` ranges of the order a row falls in, as a function of its key alone.

    The bounds are literals, picked from the keys with the least hashes, so the
    number is the same in whichever branch of a plan it is computed.  A key
    with a null in it is in the first range.
    """
    hashed = F.xxhash64(*order)
    keys = sorted(tuple(r) for r in rows.select(*order).dropna().orderBy(hashed, *order).limit(SAMPLED_KEYS).collect())
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    if not bounds:
        return F.lit(0)
    fields = [rows.schema[c].dataType.simpleString() for c in order]
    kind = ", ".join(f"{c}: {t}" for c, t in zip(order, fields, strict=True))
    literal = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, c, t in zip(bound, order, fields, strict=True)]) for bound in bounds]).cast(f"array<struct<{kind}>>")
    key = F.struct(*[F.col(c) for c in order])
    whole = F.lit(True)
    for c in order:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.size(F.filter(literal, lambda b: b <= key))).otherwise(0)


def running(rows: DataFrame, order: list[str], value: Column, name: str, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """rows with `name`: the sum of `value` over all rows up to this one (before it, if strict), by `order`.

    Rows are dealt by ranges of the order; only one total for each range meets
    in one task.  order must be unique for the sums to be.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumn("_value", value)
    ranged = valued.withColumn("_part", range_number(valued, order, ranges))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("_part").alias("_p")).agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    local = ranged.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    # One row for each range; a row whose range has none would be a mistake that must not go unseen.
    found = F.when(F.col("_p").isNotNull(), F.col("_before")).otherwise(F.raise_error(F.lit("a range of rows has no total")).cast("long"))
    return local.join(F.broadcast(totals), F.col("_part") == F.col("_p"), "left").withColumn(name, found + F.col("_local")).drop("_value", "_part", "_local", "_p", "_before")


def first_documents(docs: DataFrame, most: int, order: str = "id") -> DataFrame:
    """The first `most` documents."""
    return docs.orderBy(order).limit(most)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Of equal texts the document with the least id; blank texts go."""
    keyed = docs.filter(~T.blank(F.col("text"))).withColumn("_key", F.sha2("text", 256))
    # Minima are combined before the shuffle; texts stay where they are but for the join.
    first = keyed.groupBy(F.col("_key").alias("_k")).agg(F.min("id").alias("_first"))
    return keyed.join(first, (F.col("_key") == F.col("_k")) & (F.col("id") == F.col("_first"))).drop("_key", "_k", "_first")


def within_bytes(docs: DataFrame, most: int) -> DataFrame:
    """Documents while the bytes of those before stay below `most`; the one that crosses is cut (truncated)."""
    sized = running(docs.withColumn("bytes", F.octet_length("text").cast("long")), ["id"], F.col("bytes"), "before", strict=True)
    return sized.filter(F.col("before") < most).withColumn("kept_bytes", F.least("bytes", F.lit(most) - F.col("before"))).withColumn("truncated", F.col("kept_bytes") < F.col("bytes"))


def positions(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_pos: their place by document and order in it, from 0."""
    sizes = chunks.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
    starts = running(sizes, ["_s"], F.col("_n"), "_start", strict=True).drop("_n")
    return chunks.join(starts, F.col("source") == F.col("_s")).withColumn("chunk_pos", (F.col("_start") + F.col("ord")).cast("long")).drop("_s", "_start")


def within_chunks(chunks: DataFrame, most: int) -> DataFrame:
    return chunks.filter(F.col("chunk_pos") < most)


def within_memory(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks before the first that would exceed the estimate of memory."""
    cost = 2 * F.length("content") + 2 * F.length("source") + MEMORY_BASE
    return running(chunks, ["chunk_pos"], cost.cast("long"), "estimate").filter(F.col("estimate") <= most)


def skip_tally(docs: DataFrame, max_bytes: int) -> DataFrame:
    """reason, count of documents that aren't admitted; no identifiers."""
    first = docs.filter(~T.blank(F.col("text"))).groupBy(F.sha2("text", 256).alias("_k")).agg(F.count("*").alias("n"))
    copies = first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("count")).select(F.lit("duplicate_content").alias("reason"), "count")
    size = F.octet_length("text")
    reasons = docs.withColumn("reason", F.when(size > max_bytes, "oversized").when((size == 0) | T.blank(F.col("text")), "empty"))
    return reasons.filter("reason IS NOT NULL").groupBy("reason").count().unionByName(copies).filter(F.col("count") > 0)


def report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, bytes, longest chunk."""
    a = chunks.agg(F.countDistinct("source").alias("document_count"), F.count("*").alias("chunk_count"), F.max(F.length("content")).cast("long").alias("longest_chunk"))
    b = docs.agg(F.sum(F.octet_length("text")).cast("long").alias("total_bytes"))
    return a.crossJoin(b)  # one row each
