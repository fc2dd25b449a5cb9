"""The inverted index as DataFrame aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# Weights of a term by where it stands.
SECTION_WEIGHT = 2.5
SOURCE_WEIGHT = 1.5


@dataclass(frozen=True)
class Index:
    """An immutable version of the index; n and average are two numbers on the driver.

    sized has chunk_pos and length; stats has the norm too, which only TF-IDF reads.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    sized: DataFrame
    stats: DataFrame
    n: int
    average: float
    version: int = 1
    limits: tuple[str, ...] = ()
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Let go of what is cached, when no search reads this version any more."""
        for df in self.cached:
            df.unpersist()

    def usable(self) -> bool:
        return self.n > 0


def weighted_terms(chunks: DataFrame, key: str = "chunk_pos") -> DataFrame:
    """{key}, w, term: the weights of a chunk's terms, a row for each different unit that has the term.

    Chunks are dealt once, whole, by the key: that serves all aggregations by
    it, and a table of few files is tokenized by as many tasks as a large one.
    Units are counted before they are tokenized.
    """
    section = F.array_join(F.transform("section_path", lambda s: F.coalesce(s, F.lit(""))), " ")
    parts = F.array(
        F.struct(F.lit(1.0).alias("w"), F.col("content").alias("t")),
        F.struct(F.lit(SECTION_WEIGHT).alias("w"), section.alias("t")),
        F.struct(F.lit(SOURCE_WEIGHT).alias("w"), F.replace(F.col("source"), F.lit("/"), F.lit(" ")).alias("t")),
    )
    dealt = chunks.select(key, "content", "section_path", "source").repartition(key)
    units = dealt.select(key, F.explode(parts).alias("p")).select(key, "p.w", F.explode(T.units(F.col("p.t"))).alias("unit"))
    counted = units.groupBy(key, "unit").agg(F.sum("w").alias("w"))
    return counted.select(key, "w", F.explode(T.unit_terms(F.col("unit"))).alias("term"))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk_pos, term, tf: occurrences in the content, and in section and source with their weights."""
    return weighted_terms(chunks).groupBy("chunk_pos", "term").agg(F.sum("w").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """chunk_pos, length for every chunk, 0 for those without terms."""
    own = postings.groupBy("chunk_pos").agg(F.sum("tf").alias("length"))
    return chunks.select("chunk_pos").join(own, "chunk_pos", "left").select("chunk_pos", F.coalesce("length", F.lit(0.0)).alias("length"))


def norms(postings: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """chunk_pos, norm: root of the summed squares of tf * idf."""
    idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0
    return postings.join(terms, "term").groupBy("chunk_pos").agg(F.sqrt(F.sum(F.pow(F.col("tf") * idf, 2))).alias("norm"))


def capped_vocabulary(chunks: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct terms by chunk and by first appearance in it (content, section, source).

    A term's rank is a running count over ranges of first appearances.
    """
    from quarry.operators.ingest import running

    section = F.array_join(F.transform("section_path", lambda s: F.coalesce(s, F.lit(""))), " ")
    whole = F.concat(T.tokenize(F.col("content")), T.tokenize(section), T.tokenize(F.replace(F.col("source"), F.lit("/"), F.lit(" "))))
    seen = chunks.select("chunk_pos", F.posexplode(whole).alias("at", "term"))
    first = seen.groupBy("term").agg(F.min(F.struct("chunk_pos", "at")).alias("f")).select("term", "f.chunk_pos", "f.at")
    return running(first, ["chunk_pos", "at"], F.lit(1).cast("long"), "rank").filter(F.col("rank") <= most).select("term", "rank")


def build(chunks: DataFrame, max_terms: int | None = None, version: int = 1, keep: bool = True) -> Index:
    """Index chunks (chunk_pos, id, source, section_path, start_line, end_line, content)."""
    postings = term_frequencies(chunks)
    limits: tuple[str, ...] = ()
    if max_terms is not None:
        allowed = capped_vocabulary(chunks, max_terms).select("term")
        capped = postings.join(allowed, "term", "left_semi")
        if postings.select("term").distinct().count() > max_terms:
            postings, limits = capped, ("terms",)
    if keep:
        chunks, postings = chunks.cache(), postings.cache()
    terms = document_frequency(postings)
    sized = lengths(chunks, postings)
    if keep:
        terms, sized = terms.cache(), sized.cache()
    row = sized.agg(F.count("*"), F.sum("length")).first()
    n = row[0]
    stats = sized.join(norms(postings, terms, n), "chunk_pos", "left").select("chunk_pos", "length", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))
    return Index(chunks, postings, terms, sized, stats, n, (row[1] or 0.0) / n if n else 0.0, version, limits, (chunks, postings, terms, sized) if keep else ())


def stats_row(index: Index) -> DataFrame:
    """document_count, chunk_count, term_count."""
    a = index.chunks.agg(F.countDistinct("source").alias("document_count"), F.count("*").alias("chunk_count"))
    return a.crossJoin(index.terms.agg(F.count("*").alias("term_count")))  # one row each


def top_terms(index: Index, k: int) -> DataFrame:
    order = Window.orderBy(F.desc("df"), "term")
    return index.terms.orderBy(F.desc("df"), "term").limit(k).withColumn("rank", F.row_number().over(order))
