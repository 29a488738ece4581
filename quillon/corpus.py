"""The searchable corpus as DataFrames, from the driver's tables or any table of (id, title, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few partitions, dealt to all cores: for work that costs more than moving a small table.  Larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, title (first line, 80 characters), lang, source, doc_type, hash, last_modified, content."""
    kind = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring(F.split("text", "\n", 2)[0], 1, 80).alias("title"),
        "lang", "source",
        F.when(kind < 7, "markdown").when(kind < 9, "issue").otherwise("pull_request").alias("doc_type"),
        F.sha2("text", 256).alias("hash"),
        (F.lit(NOW).cast("timestamp") - F.make_interval(days=(F.col("doc_id") % 400).cast("int"))).alias("last_modified"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id and the embedding as doubles: three chunks a document."""
    return spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 3").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


#: The same corpus for DuckDB.
DOCS_SQL = """docs AS (
  SELECT doc_id AS id, '/' || source || '/' || lang || '/doc-' || doc_id || '.md' AS path, substr(split_part(text, chr(10), 1), 1, 80) AS title,
         lang, source, CASE WHEN doc_id % 10 < 7 THEN 'markdown' WHEN doc_id % 10 < 9 THEN 'issue' ELSE 'pull_request' END AS doc_type,
         sha256(text) AS hash, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 400 AS INTEGER)) AS last_modified, text AS content
  FROM documents)"""
CHUNKS_SQL = "chunks AS (SELECT vec_id AS chunk_id, vec_id // 3 AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"
