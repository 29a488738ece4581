"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; run() writes each stage's result as Parquet into the shared
folder and reads it again for the next.  All stages but the last return the
columns of the documents they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import near_dup, toxicity
from quillon.llm.mixing import mix
from quillon.llm.packing import pack
from quillon.llm.queries import MIX_WEIGHTS, domain_of
from quillon.llm.session import prepare, written
from quillon.llm.substrings import remove_repeats


def _row(docs: DataFrame, *left_out: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in left_out])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from the labels of these documents."""
    prepare(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = docs.select("doc_id", "text", _row(docs, "text").alias("_row"))
    scored = toxicity.score_texts(held, model, keep=["_row", "text"])
    kept = scored.filter(F.col("predicted") == 0)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays; of repeated rows, one."""
    prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = near_dup.classes(docs, with_key=True)
    # Of a class's texts the one with the smallest id, then the smallest hash; of its rows, one.
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.key").alias("_key"))
    keyed = docs.withColumn("_text_key", F.unhex(F.md5(text)))
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best["_id"]) & (keyed["_text_key"] == best["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_key"]).select(*[f"`{c}`" for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left."""
    prepare(spark)
    cut = remove_repeats(docs, row=_row(docs, "text"), verbatim=True)
    kept = cut.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, as near the target weights as one epoch allows."""
    prepare(spark)
    free = "_epoch"
    while free in docs.columns:
        free += "_"
    return mix(docs, domain_of(), MIX_WEIGHTS, share=0.9, epochs=1, epoch_col=free).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack(prepare(spark) and docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the documents of sf_dir."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
