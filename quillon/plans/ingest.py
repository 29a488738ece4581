"""Ingestion: changed Markdown files become documents, chunks and vectors, merged into written tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.embed import embed_all
from quillon.functions.markdown import chunk_all, parse_all
from quillon.functions.stem import stem_texts
from quillon.operators import stats as M
from quillon.session import written
from quillon.sources import files

SCHEMAS = {
    "documents": "id long, path string, hash string, title string, lang string, source string, doc_type string, last_modified timestamp, stemmed_title string, content string",
    "chunks": "chunk_id long, doc_id long, chunk_index int, text string, embedding array<float>",
    "sync_state": "source string, last_sync_at timestamp",
}


@dataclass
class Store:
    """Tables in a folder, each replaced as a whole: a new version is written, then a pointer names it."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        pointer = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/current.txt")
        system = pointer.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(pointer):
            return self.spark.createDataFrame([], SCHEMAS[name])
        version = self.spark.read.text(pointer.toString()).first()[0]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{version}")

    def drop_old(self, name: str) -> None:
        """Remove the versions of a table that the pointer does not name; for times without readers of them."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        current = self.spark.read.text(f"{self.folder}/{name}/current.txt").first()[0]
        for status in system.listStatus(at):
            if status.isDirectory() and status.getPath().getName() != current:
                system.delete(status.getPath(), True)

    def write(self, name: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.parquet(f"{self.folder}/{name}/{version}")
        jvm = self.spark.sparkContext._jvm
        pointer, fresh = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{n}") for n in ("current.txt", f"{version}.txt"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        out = pointer.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, options)  # in one step: a reader finds the old version or the new one


def sync_folder(store: Store, root: str, source: str, now: Column, default_lang: str = "en", provider: str = "mock", full: bool = False) -> dict[str, int]:
    """Bring one source up to date; counts of changed and deleted files.  full: all files count as changed.

    Chunks first, then documents, then the source's state, so that a failed run is repeated as a whole.
    """
    docs, chunks, state = (store.read(n) for n in SCHEMAS)
    found = files.markdown_files(store.spark, root)
    since = state.filter(F.col("source") == source).agg(F.max("last_sync_at")).first()[0]
    known = files.known_hashes(docs, source)
    changed = found if full else files.changed(found, known, F.lit(since).cast("timestamp") if since else F.lit(0).cast("timestamp"))
    gone = files.deleted(known, found)
    parsed = written(parse_all(changed, default_lang=default_lang), "parsed")  # read by titles, stems and chunks
    stems = lambda c: stem_texts(parsed.select(F.xxhash64("path").alias("id"), "lang", F.col(c).alias("content"))).select("id", F.col("stemmed").alias(c))
    incoming = parsed.select("path", F.xxhash64("path").alias("k"), "title", "lang").join(changed.select("path", "hash"), "path")
    incoming = incoming.join(stems("title").toDF("k", "stemmed_title"), "k").join(stems("text").toDF("k", "content"), "k").drop("k")
    incoming = incoming.withColumns({"source": F.lit(source), "doc_type": F.lit("markdown")})
    n_changed, n_gone = changed.count(), gone.count()
    kept, kept_chunks = M.delete_by_paths(docs, chunks, gone)
    merged = M.upsert(kept, incoming, now)
    ids = merged.join(incoming.select("path"), "path", "left_semi").select("id", "path")
    pieces = chunk_all(ids.join(parsed, "path").select("id", F.col("text").alias("content"))).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))
    vectors = embed_all(pieces, provider, "chunk_id", "text")
    fresh = pieces.join(vectors, "chunk_id").select(*chunks.columns)
    all_chunks = kept_chunks.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*chunks.columns).unionByName(fresh)
    store.write("chunks", all_chunks)
    store.write("documents", merged)
    store.write("sync_state", M.upsert_state(state, store.spark.range(1).select(F.lit(source).alias("source"), now.alias("last_sync_at"))))
    return {"changed": n_changed, "deleted": n_gone}


def maintain(store: Store) -> None:
    """Prune chunks of documents that are gone, then write both tables anew in few files; versions before the current ones go."""
    docs, chunks = store.read("documents"), store.read("chunks")
    store.write("chunks", M.prune_orphans(docs, chunks, chunks.select("chunk_id"))[0].select(*chunks.columns).coalesce(max(1, chunks.rdd.getNumPartitions() // 4)))
    store.write("documents", docs.coalesce(max(1, docs.rdd.getNumPartitions() // 4)))
    for name in ("chunks", "documents"):
        store.drop_old(name)
