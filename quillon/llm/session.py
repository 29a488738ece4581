"""Settings shared by the operators: the folder for written intermediate tables and Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.session import on_workers, shared_dir, written

__all__ = ["ARROW_ROWS", "documents", "prepare", "shared_dir", "written"]

#: Rows of one Arrow batch handed to Python; texts of some 100 KB still make batches of tens of MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return on_workers(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
