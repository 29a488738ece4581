"""Change detection over files and item feeds, and the tables it feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import compose_content, item_hash, item_path


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, content, hash of all .md files (in any case) below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.lower("path").endswith(".md")).select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def known_hashes(docs: DataFrame, source: str) -> DataFrame:
    return docs.filter(F.col("source") == source).select("path", "hash")


def changed(files: DataFrame, known: DataFrame, since: Column) -> DataFrame:
    """Files that are new, or newer than `since` with another hash."""
    joined = files.join(known.select("path", F.col("hash").alias("known_hash")), "path", "left")
    return joined.filter(F.col("known_hash").isNull() | ((F.col("mtime") > since) & (F.col("hash") != F.col("known_hash")))).drop("known_hash")


def deleted(known: DataFrame, files: DataFrame) -> DataFrame:
    return known.join(files.select("path"), "path", "left_anti").select("path")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """One row per query of a JSON file {"queries": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def items(feed: DataFrame, repository: str, kind: str) -> DataFrame:
    """Documents of an item feed (number, title, body, comments): at most the first 100 comments that are not empty."""
    comments = F.slice(F.filter("comments", lambda c: c != ""), 1, 100)
    return feed.select(
        item_path(F.lit(repository), kind, F.col("number")).alias("path"), "title", F.lit("issue" if kind == "issue" else "pull_request").alias("doc_type"),
        compose_content(F.col("title"), F.col("body"), comments).alias("content"), item_hash(F.col("title"), F.col("body"), comments).alias("hash"),
    )


def differing(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, hash of the files (path, content) whose hash is not the stored one: the check of single files."""
    hashed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    return hashed.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def open_items(feed: DataFrame, kind: str) -> DataFrame:
    """Items of a feed that are open; a feed of issues may hold pull requests, which are left out of it."""
    rows = feed.filter(F.lower("state") == "open")
    return rows.filter(~F.coalesce("is_pull_request", F.lit(False))) if kind == "issue" and "is_pull_request" in feed.columns else rows


def one_item(feed: DataFrame, number: int) -> DataFrame:
    """The item of a number, open or not."""
    return feed.filter(F.col("number") == number)


def closed_items(known: DataFrame, feed: DataFrame, repository: str, kind: str) -> DataFrame:
    """Known paths of a repository's items of a kind that are not among its open items any more."""
    here = F.concat(F.lit("gh:"), F.lit(repository), F.lit("/issues/" if kind == "issue" else "/pull/"))
    now = open_items(feed, kind).select(item_path(F.lit(repository), kind, F.col("number")).alias("path"))
    return known.filter(F.startswith("path", here)).select("path").join(now, "path", "left_anti")


def under(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents whose path begins with a prefix."""
    return docs.filter(F.startswith("path", F.lit(prefix)))
