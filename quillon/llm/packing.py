"""Sequence packing by first-fit decreasing over a tournament tree of bin capacities.

A document is its ids followed by the end id 0.  It is cut into pieces of the
sequence length from its start; full pieces are sequences of their own, the
last piece goes to first-fit decreasing.  Documents are dealt at random, by
their place in the written table of lengths, into groups of about `group_docs`;
every group packs its last pieces alone, so the work is spread and no task sees
more than its group.  In a group a tournament
tree holds the free room of the bins: each inner node has the larger room of
its two children, so the leftmost bin with enough room is found in log(bins)
steps.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own; a null id is kept as null; equal lengths are taken in
the order of id, then of the ids' checksum.  Column names of the input do not
matter beyond the two given.  The strings of the vocabulary's added tokens are
those tokens.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .session import written
from .tokenise import token_ids, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Free room of bins; finds the leftmost bin that still has the room asked for."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the room that it had."""
        best, node, leaves = self.best, 1, self.leaves
        if best[1] < size:
            raise ValueError("no bin has the room")
        while node < leaves:
            node *= 2
            if best[node] < size:
                node += 1
        had = best[node]
        chosen, best[node] = node - leaves, had - size
        node >>= 1
        while node:
            larger = max(best[2 * node], best[2 * node + 1])
            if best[node] == larger:
                break
            best[node] = larger
            node >>= 1
        return chosen, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of every item; sizes are in decreasing order."""
    tree = RoomTree(max(1, len(sizes)), room)
    put = [tree.place(int(s)) for s in sizes]
    return np.array([b for b, _ in put], np.int64), np.array([room - had for _, had in put], np.int64)


def pack_group(table: pa.Table, length: int) -> pa.Table:
    """All pieces of one group's documents with their sequences; columns: group, doc_id (null or not), doc_tokens, crcs."""
    last = pc.list_element(table.column("crcs"), 0) if not table.num_rows else pa.array([c[-1] for c in table.column("crcs").to_pylist()], pa.int64())
    table = table.append_column("last", last).append_column("rest", pa.array(table.column("doc_tokens").to_numpy() % length)).append_column("known", pc.is_valid(table.column("doc_id")))
    table = table.sort_by([("rest", "descending"), ("known", "ascending"), ("doc_id", "ascending"), ("last", "ascending")])
    tokens = table.column("doc_tokens").to_numpy()
    pieces = -(-tokens // length)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    size = np.minimum(length, tokens[doc] - start)
    rest = np.flatnonzero(size < length)  # in decreasing order, as the rows are
    bins, offsets = first_fit_decreasing(size[rest], length)
    sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    sequence[rest], offset[rest] = bins, offsets
    used = int(bins.max()) + 1 if len(bins) else 0
    full = np.flatnonzero(size == length)
    sequence[full] = used + np.arange(len(full))
    base = table.column("group")[0].as_py() << 32
    crcs = pc.list_flatten(table.column("crcs"))
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "ids_crc32": crcs, "doc_tokens": tokens[doc], "sequence_id": base + sequence, "offset": offset})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, vocabulary_file: str | None = None, group_docs: int = 8192, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary_file = vocabulary_file or vocabulary_path("byte_bpe_50k.json")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, most=8_000_000):
                ids, edges = token_ids(W.texts_of(part.column("text")), vocabulary_file)
                tokens, crcs = [], []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    raw = np.append(ids[a:b], np.uint32(0)).astype("<u4", copy=False)
                    tokens.append(len(raw))
                    crcs.append([zlib.crc32(raw[i : i + length]) for i in range(0, len(raw), length)])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "doc_tokens": pa.array(tokens, pa.int64()), "crcs": pa.array(crcs, pa.list_(pa.int64()))})

    # Written, so that a row's place in the table is the same at every reading: equal rows are dealt as any others.
    encoded = written(own.mapInArrow(encode, "doc_id long, doc_tokens long, crcs array<long>"), "pack-encoded")
    groups = max(1, math.ceil(encoded.count() / group_docs))
    dealt = encoded.select(F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group"), "*")
    return dealt.groupBy("group").applyInArrow(lambda t: pack_group(t, length), SCHEMA)
