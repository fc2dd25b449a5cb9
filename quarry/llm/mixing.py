"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by weight; a source that would repeat its
documents more often than `max_epochs` is clamped there and the excess goes to
the others in proportion to their weights, until no target is above its cap.

The fixpoint has a closed form.  With caps c and weights w, targets are
min(c, level * w); ordering sources by c / w, the clamped ones come first, so
prefix sums over that order give the level without iterating.

A source whose target is e times its size takes floor(e) whole repetitions of
every document and a fraction f of one more.  For that fraction documents fall
into `buckets` seeded hash buckets; buckets below the source's cut are taken
whole, those above are not, and the bucket at the cut gives of every document
the same part, so that the source's words come out at the target but for
rounding.  The bucket table is the only thing that is shuffled: one row per
source and bucket, pre-aggregated, however many documents a source has.  Texts
are never moved.

Everything is DataFrame expressions; there is no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 1024
SEED = "mix-7"
#: The table of sources (one small row each) is broadcast up to this many; beyond, Spark joins it by shuffle.
BROADCAST_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_bucket(key: Column, seed: str = SEED, buckets: int = BUCKETS) -> Column:
    """A bucket from 0 to buckets - 1 that depends on the key and the seed alone (a null key counts as '')."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Sources are ranked by code point, null last, and weigh `weights` in turn.
    The windows see one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.withColumn("_i", (F.row_number().over(rank) - 1) % len(weights))
    weighed = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    level = (F.col("_budget") - F.col("_clamped")) / F.col("_open")
    return (
        weighed.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("_cap").over(everything)))
        .withColumn("_clamped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        # The level that holds if this source is the first unclamped one; the first that fits under its cap is the true level, and the greatest of all that fit.
        .withColumn("_fits", F.when(level * F.col("_w") <= F.col("_cap"), level))
        .withColumn("_level", F.max("_fits").over(everything))
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w"))))
        .select("source", "source_size", "target")
    )


def plan(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, _bucket, size) -> one row per source: source_size, target, whole, cut, part.

    whole: repetitions every document gets; cut: the bucket at which the
    fractional repetition ends; part: the share of each document taken there.
    """
    filled = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    goals = targets(filled.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    goals = goals.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = goals.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = filled.withColumn("_upto", F.sum("_words").over(order)).withColumnRenamed("source", "_s")
    cut = run.join(goals, F.col("_s").eqNullSafe(F.col("source")), "inner")
    at_cut = (F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_words") <= F.col("_rest"))
    return (
        cut.groupBy("source", "source_size", "target", "_whole")
        .agg(
            F.min(F.when(at_cut, F.col("_bucket"))).alias("_cut"),
            F.min(F.when(at_cut, (F.col("_rest") - (F.col("_upto") - F.col("_words"))) / F.col("_words"))).alias("_part"),
        )
    )


#: What `mix` adds to the rows.
ADDED = ("size", "source_size", "target", "taken", "_whole", "_extra_words")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, mark: str = "") -> DataFrame:
    """`docs` with size, source_size, target, taken, _whole and _extra_words, each name with `mark` before it.

    Needs doc_id, text and source; other columns pass through, but for those
    with one of the added names, which give way.  A null text has no words; a
    null source is a source of its own, ranked last; a null id and repeated ids
    share a bucket and are decided alike; an empty table stays empty.  taken =
    whole repetitions times size + words of the last, partial one.  The plan is
    written to the shared folder first and counted; up to BROADCAST_SOURCES
    sources it is broadcast, beyond that joined by shuffle.
    """
    inner = "_quarry_mix_"
    while any(c.startswith(inner) for c in docs.columns if c not in {mark + x for x in ADDED}):
        inner += "_"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {mark + x for x in ADDED}]
    size, bucket = f"{inner}size", f"{inner}bucket"
    sized = docs.select(*kept, word_count(F.col("text")).alias(size), seeded_bucket(F.col("doc_id"), seed).alias(bucket))
    decided = plan(sized.select("source", F.col(bucket).alias("_bucket"), F.col(size).alias("size")), weights, share, max_epochs)
    decided = materialize(decided.select(*[F.col(c).alias(f"{inner}of_{c}") for c in decided.columns]), "mix-plan")
    if decided.count() <= BROADCAST_SOURCES:
        decided = F.broadcast(decided)
    of = lambda c: F.col(f"{inner}of_{c}")
    extra = (
        F.when(of("_cut").isNull() | (F.col(bucket) > of("_cut")), F.lit(0))
        .when(F.col(bucket) < of("_cut"), F.col(size))
        .otherwise(F.floor(F.col(size) * of("_part") + F.lit(0.5)))
        .cast("long")
    )
    joined = sized.join(decided, F.col("source").eqNullSafe(of("source")), "inner").withColumn(f"{inner}extra", extra)
    added = (F.col(size), of("source_size"), of("target"), (of("_whole") * F.col(size) + F.col(f"{inner}extra")).cast("long"), of("_whole"), F.col(f"{inner}extra"))
    return joined.select(*kept, *[c.alias(mark + name) for name, c in zip(ADDED, added, strict=True)])


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: documents with their columns, whole repetitions as rows, the partial one cut to its words.

    Columns may have any names and come back as they were.  Edge cases are those of `mix`.
    """
    mark = "_quarry_own_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    size, whole, words = F.col(f"{mark}size"), F.col(f"{mark}_whole"), F.col(f"{mark}_extra_words")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), 1, F.greatest(words, F.lit(1)).cast("int")), " ")
    copies = F.concat(F.array_repeat(F.lit(True), whole.cast("int")), F.when(words > 0, F.array(words >= size)).otherwise(F.array().cast("array<boolean>")))
    rows = mix(docs, mark=mark, **how).withColumn(f"{mark}full", F.explode(copies))
    text = F.when(F.col(f"{mark}full"), F.col("text")).otherwise(first).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the mix of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024 AS bucket
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, least(sum(source_size) OVER () * 1.5::DOUBLE, sum(cap) OVER ()) AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT *, max(CASE WHEN (budget - clamped) / open * w <= cap THEN (budget - clamped) / open END) OVER () AS level FROM b),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
f AS (SELECT source, bucket, sum(size) AS words FROM d GROUP BY source, bucket),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM f),
c AS (SELECT r.source, bucket AS cut, (target - whole * source_size - (upto - words)) / words AS part
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
      WHERE upto > target - whole * source_size AND upto - words <= target - whole * source_size)
SELECT doc_id, size, g.source_size, g.target,
       (whole * size + CASE WHEN cut IS NULL OR bucket > cut THEN 0 WHEN bucket < cut THEN size
                            ELSE floor(size * part + 0.5) END)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
