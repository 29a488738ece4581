"""Questions about hashed keys, sent from groups of documents to key shards and answered back.

Documents are dealt into groups by their id and text.  A group states each of its
distinct keys once, as sorted 64-bit numbers in one compressed block per shard
of the key range; a shard sees all blocks of its range and answers each group.
However often a key occurs, a shard gets it once per group, so a very frequent
key weighs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bytes of text in a group of documents, and of the texts behind a shard of the keys.
GROUP_BYTES = 4_000_000


def planes(values: np.ndarray) -> bytes:
    """A number array, transposed to byte planes and compressed: high planes of small numbers vanish."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unplanes(block: bytes, kind: type = np.uint64) -> np.ndarray:
    item = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(raw.reshape(item, len(raw) // item).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=W.U(0)))


def unpack_keys(block: bytes) -> np.ndarray:
    return np.cumsum(unplanes(block), dtype=W.U)


def pack_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_bits(block: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8), count=size).astype(bool)


def shard_edges(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, end) of sorted keys for each shard that has some."""
    limits = np.array([(s << 64) // shards for s in range(1, shards)], W.U)
    edges = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
    return [(s, a, b) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def grouped(docs: DataFrame, id_col: str, text_col: str, more: dict[str, Column] | None = None, group_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(g, doc_id, text, ...), dealt by g, a group of documents by id and text, so that many texts of one id, or of none, part; and the number of groups, which is that of shards too."""
    more = more or {}
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / (group_bytes or GROUP_BYTES)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 8)
    return own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text", *more).repartition(parts, "g"), groups


def in_order(table: pa.Table) -> pa.Table:
    """A group's documents by id, null first, then by text: the same at every reading."""
    by_id = [("doc_id", "ascending"), ("text", "ascending")]
    missing = pc.is_null(table.column("doc_id"))
    return pa.concat_tables([table.filter(missing).sort_by(by_id), table.filter(pc.invert(missing)).sort_by(by_id)])


def slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from W.pieces(batch)
