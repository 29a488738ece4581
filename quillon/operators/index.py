"""Inverted index: postings with positions, vocabulary, document lengths and corpus statistics, written once and read by searches."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import fold_diacritics, token_line, tokenize
from quillon.operators import scan


@dataclass
class Index:
    """postings: term, doc_id, title_tf, content_tf, positions (in the content).  vocabulary: term, n_docs.

    tokens: doc_id, title_tokens, content_tokens (arrays, or lines with a space between tokens), not folded; searches
    read these alone.
    lengths: doc_id, length.  stats: one row, n_docs, mean_length.  folded: terms have no diacritics, and those of a
    query are folded likewise.  whole: the tokens are those of all documents in the statistics.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    folded: bool = False
    vocabulary: DataFrame | None = None
    tokens: DataFrame | None = None
    whole: bool = True

    def terms(self) -> DataFrame:
        """The distinct terms."""
        return self.postings.select("term").distinct() if self.vocabulary is None else self.vocabulary.select("term")


def tokens_of(docs: DataFrame) -> DataFrame:
    """id with the token arrays of its title and content; a null one has none."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(F.col("id").alias("doc_id"), tokenize(text("title")).alias("title_tokens"), tokenize(text("content")).alias("content_tokens"))


def lines_of(docs: DataFrame) -> DataFrame:
    """tokens_of with lines of tokens in place of arrays, for one pass in Arrow batches."""
    line = lambda c: token_line(F.coalesce(F.col(c), F.lit("")))
    return docs.select(F.col("id").alias("doc_id"), *[line(c).alias(f"{c}_tokens") for c in ("title", "content") if c in docs.columns])


def _postings(tokens: DataFrame, folded: bool) -> DataFrame:
    """Aggregated before the shuffle; a place in the title counts below zero."""
    places = F.concat(F.transform("title_tokens", lambda t, i: F.struct(t.alias("term"), (-1 - i).alias("at"))), F.transform("content_tokens", lambda t, i: F.struct(t.alias("term"), i.alias("at"))))
    each = tokens.select("doc_id", F.explode(places).alias("t"))
    term = fold_diacritics(F.col("t.term")) if folded else F.col("t.term")
    at = each.groupBy(term.alias("term"), "doc_id").agg(F.count(F.when(F.col("t.at") < 0, 1)).alias("title_tf"), F.array_sort(F.collect_list(F.when(F.col("t.at") >= 0, F.col("t.at")))).alias("positions"))
    return at.select("term", "doc_id", "title_tf", F.size("positions").cast("long").alias("content_tf"), "positions")


def build(docs: DataFrame, folded: bool = True) -> Index:
    """The index as a plan; `write` keeps it."""
    tokens = tokens_of(docs)
    marked = F.concat(F.transform("title_tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("title"))), F.transform("content_tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("title"))))
    each = tokens.select("doc_id", F.explode(marked).alias("t"))
    term = fold_diacritics(F.col("t.term")) if folded else F.col("t.term")
    postings = each.groupBy(term.alias("term"), "doc_id").agg(F.sum("t.title").alias("title_tf"), F.sum(1 - F.col("t.title")).alias("content_tf"))
    lengths = tokens.select("doc_id", (F.size("title_tokens") + F.size("content_tokens")).cast("long").alias("length"))
    return Index(postings, lengths, lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length")), folded, tokens=lines_of(docs))


def term_counts(tokens: DataFrame, folded: bool = True) -> DataFrame:
    """term, n_docs, title_tf, content_tf over documents (doc_id with one or both columns of tokens), counted batch by batch before the shuffle."""
    each = tokens.mapInArrow(scan.term_counts(folded), "term string, n_docs long, title_tf long, content_tf long")
    return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n_docs", "title_tf", "content_tf")])


def _bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))


def _name(path: str) -> str:
    """The catalog's name for a table of an index."""
    return f"quillon_{hashlib.md5(path.encode()).hexdigest()}"


def write(docs: DataFrame, path: str, folded: bool = True, bucket_bytes: int = 128_000_000) -> None:
    """Tables of an index below a folder: one pass tokenises; postings are bucketed by term.  Searches read the tokens alone."""
    spark = docs.sparkSession
    tokens_of(docs).write.mode("overwrite").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    tokens.select("doc_id", (F.size("title_tokens") + F.size("content_tokens")).cast("long").alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    facts = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(32 * facts.first()["tokens"] / bucket_bytes))
    facts.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")
    _bucketed(_postings(tokens, folded), f"{path}/postings", "term", buckets)
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("n_docs")).write.mode("overwrite").parquet(f"{path}/vocabulary")


def read(spark: SparkSession, path: str, folded: bool = True) -> Index:
    """The index of a folder; its bucketed table is made known to the session's catalog if it is not."""
    lengths, stats, vocabulary = (spark.read.parquet(f"{path}/{n}") for n in ("lengths", "stats", "vocabulary"))
    buckets = stats.first()["buckets"]
    name = _name(f"{path}/postings")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (term STRING, doc_id BIGINT, title_tf BIGINT, content_tf BIGINT, positions ARRAY<INT>) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    return Index(spark.table(name), lengths.select("doc_id", "length"), stats.select("n_docs", "mean_length"), folded, vocabulary, read_tokens(spark, path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title_tokens, content_tokens as they were indexed, not folded."""
    return spark.read.parquet(f"{path}/tokens")


def positions(docs: DataFrame, column: str = "content") -> DataFrame:
    """term, doc_id, pos of one column."""
    return docs.select(F.col("id").alias("doc_id"), F.posexplode(tokenize(F.col(column))).alias("pos", "term"))


def is_consecutive(places: Column) -> Column:
    """Whether arrays of positions, one for each word in order, hold one place after another somewhere."""
    first = F.element_at(places, 1)
    return F.exists(first, lambda p: F.forall(F.transform(places, lambda ps, i: F.array_contains(ps, p + i)), lambda x: x))
