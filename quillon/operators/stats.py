"""Counts, facets and maintenance of the corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def count_by(docs: DataFrame, column: str) -> DataFrame:
    return docs.groupBy(column).agg(F.count("*").alias("n"))


def facets(docs: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """facet, value, n for source, doc_type and lang in one pass over the rows; null counts as ''."""
    if sources:
        docs = docs.filter(F.col("source").isin(list(sources)))
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in ("source", "doc_type", "lang")])
    return docs.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def stats(docs: DataFrame) -> DataFrame:
    """One row: total, counts by source and by type as maps, last change."""
    by = facets(docs).filter(F.col("facet") != "lang").groupBy("facet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("m"))
    total = docs.agg(F.count("*").alias("total_docs"), F.max("last_modified").alias("last_sync"))
    maps = by.agg(F.first(F.when(F.col("facet") == "source", F.col("m")), ignorenulls=True).alias("by_source"), F.first(F.when(F.col("facet") == "doc_type", F.col("m")), ignorenulls=True).alias("by_doc_type"))
    return total.crossJoin(maps)


def overview(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total_docs"), F.countDistinct("source").alias("n_sources"), F.countDistinct("doc_type").alias("n_doc_types"), F.max("last_modified").alias("last_sync"))


def prune_orphans(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of known documents, then vectors of those chunks."""
    kept = chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return kept, vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, now: Column, key: str = "path") -> DataFrame:
    """Rows of existing replaced by incoming ones of the same key; ids are kept, new ones come from the key's hash.

    Of incoming rows of one key the last in the order of all their columns counts, so one stays.
    """
    whole = F.struct(*[F.col(c) for c in incoming.columns])
    incoming = incoming.groupBy(key).agg(F.max(whole).alias("_last")).select("_last.*")
    known = existing.select(key, F.col("id").alias("known_id"))
    fresh = incoming.join(known, key, "left").withColumn("id", F.coalesce("known_id", F.xxhash64(key))).withColumn("last_modified", now).select(*existing.columns)
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(fresh)


def delete_by_paths(docs: DataFrame, chunks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = docs.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("doc_id"))
    return docs.join(paths.select("path"), "path", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def upsert_state(state: DataFrame, row: DataFrame) -> DataFrame:
    return state.join(row.select("source"), "source", "left_anti").select(*state.columns).unionByName(row.select(*state.columns))


def prune_postings(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings, or the token rows that they come from, of known documents."""
    return postings.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def paths_by_source(docs: DataFrame) -> DataFrame:
    """source, n, paths in order: one row a source, its list in its own row; meant for writing, not for collecting."""
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def link_count(edges: DataFrame) -> DataFrame:
    """doc_id, n_out, n_in of distinct links."""
    each = edges.select("src", "dst").distinct()
    ends = each.select(F.col("src").alias("doc_id"), F.lit(1).alias("out")).unionByName(each.select(F.col("dst").alias("doc_id"), F.lit(0).alias("out")))
    return ends.groupBy("doc_id").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"))


def stored_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files and bytes below a folder; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
