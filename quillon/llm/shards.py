"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group and stay together.  Groups are placed from the largest
down, each into the shard where the dot product of the group's vector (bytes,
tokens, rows as shares of the corpus) with the shard's residual capacity is
highest.

* Heavy groups, of more than 1/64 of a shard in bytes, tokens or rows, are placed
  first, on the driver: there are at most 3 * 64 for each shard, whatever the
  corpus holds.  A group too large for one shard in any of the three is split
  into pieces of about 1/64 of a shard by the places of its rows in a written
  table, so that equal rows part like any others.
* All other groups are dealt at random into cells of about `cell_groups`
  groups.  Every cell packs its groups alone into its share of the capacity
  that the heavy groups have left, so cells run in parallel and their sum is
  balanced.

Slots are numbered by counting rows in small parts of each shard.

Defined results: a null text counts as an empty one; repeated rows are rows of
their own; rows with a null id are placed as any other; an empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

HEAVY, ROW_BYTES = 64, 16
MEASURES = ("bytes", "tokens", "rows")
#: Of bytes, tokens and rows in the dot product: the last, smallest groups even out the bytes.
WEIGHTS = np.array([1.0, 1.0, 0.2])


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each group; vectors in the order of placing, residual is reduced in place."""
    chosen = np.empty(len(vectors), np.int32)
    for i, vector in enumerate(vectors):
        s = int(np.argmax(residual @ (vector * WEIGHTS)))
        chosen[i] = s
        residual[s] -= vector
    return chosen


def _descending(vectors: np.ndarray, names: np.ndarray) -> np.ndarray:
    return np.lexsort((names, -vectors.max(axis=1)))


def _cell(rows: pd.DataFrame, total: np.ndarray, residual: np.ndarray) -> pd.DataFrame:
    vectors = rows[list(MEASURES)].to_numpy(float) / total
    order = _descending(vectors, rows.h1.to_numpy())
    room = np.maximum(residual, 0)
    room = room * (vectors.sum(axis=0) / np.maximum(room.sum(axis=0), 1e-300))
    chosen = place(vectors[order], room)
    return pd.DataFrame({"h1": rows.h1.to_numpy()[order], "h2": rows.h2.to_numpy()[order], "shard": chosen})


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(buckets)).cast("int")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, cell_groups: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot: one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"),
    )
    buckets = max(1024, HEAVY * shards)
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")), "shard-rows")
    units = rows.groupBy("h1", "h2", "bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    sums = [F.sum(c).alias(c) for c in MEASURES]
    groups = units.groupBy("h1", "h2").agg(*sums)
    first = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    total = np.maximum(np.array([first[0] or 0, first[1] or 0, first[2] or 0], float), 1)
    share = total / shards
    of_shard = F.greatest(*[F.col(c) / float(x) for c, x in zip(MEASURES, share, strict=True)])

    # Heavy groups: fewer than 3 * HEAVY * shards, as each has more than 1 / HEAVY of a shard in one of three measures.
    groups = groups.withColumn("part", of_shard)
    heavy = groups.filter(F.col("part") > 1 / HEAVY).toPandas()
    whole, large = heavy[heavy.part <= 0.9], heavy[heavy.part > 0.9]
    spark = docs.sparkSession
    cut = [(int(g.h1), int(g.h2), min(buckets, math.ceil(g.part * HEAVY))) for g in large.itertuples()]
    pieces = units.join(F.broadcast(spark.createDataFrame(cut, "h1 long, h2 long, pieces int")), ["h1", "h2"])
    pieces = pieces.groupBy("h1", "h2", "pieces", (F.col("bucket") % F.col("pieces")).alias("piece")).agg(*sums).toPandas()
    columns = ["h1", "h2", "pieces", "piece", *MEASURES]
    placed = pd.concat([whole.assign(piece=0, pieces=1)[columns], pieces[columns]], ignore_index=True)
    vectors = placed[list(MEASURES)].to_numpy(float) / total
    order = _descending(vectors, placed.h1.to_numpy(np.int64) + placed.piece.to_numpy(np.int64))
    residual = np.full((shards, 3), 1 / shards)
    placed = placed.iloc[order].assign(shard=place(vectors[order], residual))
    known = spark.createDataFrame([tuple(map(int, r)) for r in placed[["h1", "h2", "piece", "pieces", "shard"]].itertuples(index=False)], "h1 long, h2 long, piece int, pieces int, heavy_shard int")
    sizes = known.select("h1", "h2", "pieces").distinct()

    cells = max(1, math.ceil(total[2] / cell_groups))
    light = groups.filter(F.col("part") <= 1 / HEAVY).withColumn("cell", _bucket(cells, "h1", "h2"))
    packed = light.groupBy("cell").applyInPandas(lambda r: _cell(r, total, residual), "h1 long, h2 long, shard int")

    rows = rows.join(F.broadcast(sizes), ["h1", "h2"], "left")
    split = rows.filter(F.col("pieces").isNotNull()).withColumn("piece", (F.col("bucket") % F.col("pieces")).cast("int"))
    from_heavy = split.join(F.broadcast(known.drop("pieces")), ["h1", "h2", "piece"]).withColumnRenamed("heavy_shard", "shard")
    from_light = rows.filter(F.col("pieces").isNull()).join(packed, ["h1", "h2"])
    own = ["doc_id", "size", "text_crc32", "tokens", "h1", "shard"]
    # Slots: rows before this one in the shard's earlier parts, and in its own; parts are of rows by their places.
    parts = F.pmod(F.xxhash64(F.lit(13), F.monotonically_increasing_id()), F.lit(max(1, math.ceil(total[2] / shards / 4096)))).cast("int")
    both = written(from_heavy.select(own).unionByName(from_light.select(own)).withColumn("part", parts), "shard-placed")
    before = both.groupBy("shard", "part").count().withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "h1")) - 1
    ranked = both.withColumn("within", within).join(before.select("shard", "part", "start"), ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("within")).alias("slot"))
