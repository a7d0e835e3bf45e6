"""Kept inverted lists: which article holds which term, in buckets of terms and segments of changes.

``postings/segment=…/bucket=…`` hold (term, id, n, total): the term is n of the article's total terms. ``dropped/segment=…`` hold
the ids that a segment changed or removed: their postings in earlier segments count no more. ``segments`` name the segments that
are complete. A segment written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.functions.text import tokens
from faultlens.sources.stage import stage

BUCKETS = 32
SLICE_ARTICLES = 1_000_000  # so many articles share a slice of a bucket: a word in half of them is cut into many files
GRAM = 3
_POSTING = "term string, id long, n long, total int, segment int, bucket int"


def article_text(content: Column, keywords: Column) -> Column:
    return F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(keywords, F.lit("")))


def article_words(kb: DataFrame) -> DataFrame:
    """(id, terms): all words of content and keywords, repeats included."""
    return kb.select("id", tokens(article_text(F.col("content"), F.col("keywords"))).alias("terms"))


def _grams(chars: Column, size: int) -> Column:
    """Runs of ``size`` characters, for texts with as many."""
    last = F.size(chars) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(*[F.get(chars, i - 1 + j) for j in range(size)]))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def _characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def symptom_grams(kb: DataFrame) -> DataFrame:
    """(id, terms): the different runs of one to ``GRAM`` characters of the symptoms."""
    chars = kb.select("id", _characters(F.coalesce("symptoms", F.lit(""))).alias("chars"))
    return chars.select("id", F.array_distinct(F.concat(*[_grams(F.col("chars"), k) for k in range(1, GRAM + 1)])).alias("terms"))


def pattern_grams(pattern: Column) -> Column:
    """Runs of characters that every text LIKE the pattern holds: of each literal part the runs of ``GRAM``, or the whole part
    where it is shorter. Parts are what lies between wildcards; a backslash makes the next character literal."""
    parts = F.transform(
        F.regexp_extract_all(pattern, F.lit(r"((?:\\.|[^%_\\])+)"), F.lit(1)), lambda p: _characters(F.regexp_replace(p, r"\\(.)", "$1"))
    )
    runs = F.transform(parts, lambda c: F.when(F.size(c) >= GRAM, _grams(c, GRAM)).otherwise(F.array(F.array_join(c, ""))))
    return F.array_distinct(F.flatten(runs))


def postings_of(terms: DataFrame) -> DataFrame:
    """(term, id, n, total) of terms(id, terms)."""
    # explode_outer: explode would add a filter that splits every text a second time
    rows = terms.select("id", F.size("terms").alias("total"), F.explode_outer("terms").alias("term"))
    return rows.filter("term IS NOT NULL").groupBy("term", "id", "total").agg(F.count(F.lit(1)).alias("n")).select("term", "id", "n", "total")


def found_now(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, id, n, total) of the asked(term) terms alone, without a kept list: all articles are split."""
    rows = terms.select("id", F.size("terms").alias("total"), F.explode_outer("terms").alias("term"))
    return rows.join(asked, "term").groupBy("term", "id", "total").agg(F.count(F.lit(1)).alias("n")).select("term", "id", "n", "total")


@dataclass(frozen=True)
class TermIndex:
    """An inverted list below ``base`` of what ``terms`` (articles → (id, terms)) finds in articles."""

    spark: SparkSession
    base: str
    terms: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def add(self, articles: DataFrame, segment: int, gone: DataFrame | None = None, slice_articles: int = SLICE_ARTICLES) -> None:
        """Adds a segment: new articles and new states of known ones; gone(id) are removed. Later segments have higher numbers.

        A bucket's rows are dealt by slices of the articles and lie sorted by term, so that one word in half of all
        articles is written and read by as many tasks as there are slices.
        """
        changed = articles.select("id") if gone is None else articles.select("id").unionByName(gone.select("id"))
        sizes = articles.select(F.count(F.lit(1)).alias("n_articles"))
        slices = max(1, -(-sizes.first()["n_articles"] // slice_articles))
        rows = self.terms(articles).select("id", F.size("terms").alias("total"), F.explode_outer("terms").alias("term"))
        dealt = rows.filter("term IS NOT NULL").select(
            "term", "id", "total", self._bucket().alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice")
        ).repartition("bucket", "slice")
        counted = dealt.groupBy("bucket", "slice", "term", "id", "total").agg(F.count(F.lit(1)).alias("n"))  # no further shuffle
        counted.select("term", "id", "n", "total", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").mode(
            "overwrite"
        ).parquet(f"{self.base}/postings/segment={segment}")
        changed.distinct().write.mode("overwrite").parquet(f"{self.base}/dropped/segment={segment}")
        sizes.write.mode("overwrite").parquet(f"{self.base}/segments/segment={segment}")

    def segments(self) -> list[int]:
        rows = self.spark.read.schema("n_articles long, segment int").parquet(f"{self.base}/segments")
        return sorted(r["segment"] for r in rows.select("segment").distinct().collect())  # one per change

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """(term, id, n, total) of the articles as they are now; with asked(term, distinct) only of these terms, from their buckets."""
        segments = self.segments()
        rows = self.spark.read.schema(_POSTING).parquet(f"{self.base}/postings").filter(F.col("segment").isin(segments))
        if asked is not None:
            wanted = [r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # at most one per bucket
            rows = rows.filter(F.col("bucket").isin(wanted)).join(asked, "term")
        if len(segments) > 1:
            dropped = self.spark.read.schema("id long, segment int").parquet(f"{self.base}/dropped").filter(
                F.col("segment").isin(segments) & (F.col("segment") > segments[0])
            )
            last = dropped.groupBy(F.col("id").alias("d_id")).agg(F.max("segment").alias("d_segment"))
            rows = rows.join(last, (F.col("id") == F.col("d_id")) & (F.col("d_segment") > F.col("segment")), "left_anti")
        return rows.select("term", "id", "n", "total")

    def compacted(self, base: str) -> TermIndex:
        """The same postings in one segment below a new place."""
        new = replace(self, base=base)
        rows = self.postings().withColumn("bucket", self._bucket())
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id").write.partitionBy(
            "bucket"
        ).mode("overwrite").parquet(f"{base}/postings/segment=0")
        rows.select(F.count_distinct("id").alias("n_articles")).write.mode("overwrite").parquet(f"{base}/segments/segment=0")
        return new


@dataclass(frozen=True)
class SearchIndex:
    """Kept words of the articles and kept character runs of their symptoms."""

    words: TermIndex
    grams: TermIndex

    def add(self, articles: DataFrame, segment: int, gone: DataFrame | None = None) -> None:
        articles = stage(articles.select("id", "content", "keywords", "symptoms"), "indexed-articles")
        gone = None if gone is None else stage(gone.select("id"), "gone-articles")
        self.words.add(articles, segment, gone)
        self.grams.add(articles, segment, gone)


def search_index(spark: SparkSession, base: str, buckets: int = BUCKETS) -> SearchIndex:
    base = base.rstrip("/")
    return SearchIndex(
        TermIndex(spark, f"{base}/words", article_words, buckets), TermIndex(spark, f"{base}/grams", symptom_grams, buckets)
    )
