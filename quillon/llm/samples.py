"""Bounded samples of labelled rows for fitting in one process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, label: Column, allowed: Column, per_class: int, classes: list[int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` labelled texts of each class, as rows of id, label and text, and the class sizes among the allowed labels.

    The rows are those whose ids have the smallest hashes, so the sample does not depend on the order of rows.
    An id that stands in several documents gives the least of their texts; one labelled twice, the least of its labels.
    """
    known = labels.select(F.col(id_col).alias("id"), label.alias("label")).filter(allowed & F.col("label").isNotNull() & F.col("id").isNotNull())
    sizes = {int(r[0]): int(r[1]) for r in known.groupBy("label").count().collect() if r[0] in classes}
    picked = None
    for c in classes:
        part = known.filter(F.col("label") == c).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    ids = picked.groupBy("id").agg(F.min("label").alias("label"))  # at most per_class rows for each class
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), sizes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, allowed: Column, per_class: int, classes: list[int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """The rows of labelled_rows on the driver, as (id, class, text) in order, and the class sizes."""
    rows, sizes = labelled_rows(docs, labels, label, allowed, per_class, classes, id_col, text_col)
    return sorted((r.id, int(r.label), r.text) for r in rows.collect()), sizes
