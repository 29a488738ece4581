"""Exact top-k inner products with a bit-sliced index.

Components are quantised to whole numbers.  A block of rows holds, for every
component, one bitmap per bit of its value (offset to be non-negative).  The
slices of small groups of components are added once for every subset of a
group.  For a query these sums are added, one subset for each bit of the
query's components and shifted by it, with carry-save adders on whole bitmaps,
so that a few bitmaps hold the sums of all rows of a block.
The k best rows are then selected from the most significant slice downward:
rows with the bit set are in while they are at most k, else they are the only
ones left to decide between.  Rows that tie at the boundary are taken in the
order of their ids, and the scores of the rows selected are read off the slices.

Blocks of queries meet blocks of rows by an equal block number, so neither the
rows nor the queries are broadcast; every pair of blocks gives at most k rows
for each query, of which the k best are kept.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; of vectors shorter than the longest the missing components count
as 0; repeated ids are rows of their own, but none is a candidate for its own
id, and a repeated query is one query with the rows of all; ties go to the
smaller id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

U = np.uint64


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (component, bit, word) of rows of whole numbers, and the offset of each component."""
    low = values.min(axis=0)
    shifted = (values - low).astype(U)
    bits = max(1, int(shifted.max()).bit_length()) if values.size else 1
    words = (len(values) + 63) // 64
    flags = np.zeros((values.shape[1], bits, words * 64), bool)
    for b in range(bits):
        flags[:, b, : len(values)] = ((shifted >> U(b)) & U(1)).astype(bool).T
    return np.packbits(flags, axis=2, bitorder="little").view(U).reshape(values.shape[1], bits, words), low


def _plus(a: list[int], b: list[int]) -> list[int]:
    """Sum of two bit-sliced numbers, least significant slice first; a slice is a whole number of one bit a row."""
    out, carry = [], 0
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else 0, b[i] if i < len(b) else 0
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    return [*out, carry] if carry else out


class Sums:
    """A block's slices, and for groups of components the sums of every subset of them.

    The sums of all queries are put together from these, one subset for each bit of the query's components.
    """

    def __init__(self, slices: np.ndarray, low: np.ndarray, rows: int, most: int = 32_000_000) -> None:
        width, bits, words = slices.shape
        self.low, self.every = low, (1 << rows) - 1
        size = lambda g: width / g * (1 << g) * (bits + g.bit_length()) * words * 8
        self.group = max((g for g in range(1, 9) if size(g) <= most), default=1)
        own = [[int.from_bytes(slices[d, b].tobytes(), "little") for b in range(bits)] for d in range(width)]
        self.tables: list[list[list[int]]] = []
        for first in range(0, width, self.group):
            table: list[list[int]] = [[]]
            for subset in range(1, 1 << min(self.group, width - first)):
                last = subset.bit_length() - 1
                table.append(_plus(table[subset ^ (1 << last)], own[first + last]))
            self.tables.append(table)

    def subsets(self, queries: np.ndarray) -> np.ndarray:
        """(query, bit of two's complement, group): which components have the bit."""
        top = int(np.abs(queries).max(initial=0)).bit_length()
        out = np.zeros((len(queries), top + 1, len(self.tables)), np.int64)
        for d in range(queries.shape[1]):
            out[:, :, d // self.group] |= (queries[:, d, None] >> np.arange(top + 1) & 1) << (d % self.group)
        return out

    def add(self, query: np.ndarray, subsets: list[list[int]]) -> tuple[list[int], int]:
        """Slices of the sums of query * value, and the number to add to them.

        The highest bit counts below zero: its sums come complemented.  Columns of equal weight are reduced three to
        two with full adders.
        """
        columns: list[list[int]] = []
        offset = sum(int(q) * int(x) for q, x in zip(query.tolist(), self.low.tolist(), strict=True))
        last = len(subsets) - 1
        for weight, of_groups in enumerate(subsets):
            for table, subset in zip(self.tables, of_groups, strict=True):
                number = table[subset]
                if not number:
                    continue
                while len(columns) < weight + len(number):
                    columns.append([])
                if weight == last:
                    offset -= ((1 << len(number)) - 1) << weight
                    for i, s in enumerate(number):
                        columns[weight + i].append(self.every ^ s)
                else:
                    for i, s in enumerate(number):
                        columns[weight + i].append(s)
        out: list[int] = []
        weight = 0
        while weight < len(columns):
            column = columns[weight]
            if len(column) > 1 and weight + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[weight + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                columns[weight + 1].append(a & b)
            out.append(column[0] if column else 0)
            weight += 1
        return out, offset


def places(bitmap: int, rows: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap.to_bytes((rows + 7) // 8, "little"), np.uint8), bitorder="little"))


def top_rows(sums: list[int], valid: int, k: int, rows: int) -> np.ndarray:
    """Places of the k rows with the largest sums among the valid; boundary ties by place."""
    sure, open_, have = 0, valid, 0
    for s in reversed(sums):
        up = open_ & s
        n = up.bit_count()
        if have + n > k:
            open_ = up
        else:
            sure |= up
            have += n
            open_ &= ~s
            if have == k:
                break
    return np.sort(np.concatenate([places(sure, rows), places(open_, rows)[: k - have]]))


def _rows(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), width)
    return ids, values


def _blocks(batches: Iterator[pa.RecordBatch], width: int, size: int, index: bool) -> Iterator[pa.RecordBatch]:
    """A partition's rows in blocks of up to `size`, as bit slices (index) or as plain numbers (queries)."""
    ids, values = [], []
    made = itertools.count(TaskContext.get().partitionId() if TaskContext.get() else 0, 1009)

    def emit() -> pa.RecordBatch:
        i, v = np.concatenate(ids), np.concatenate(values)
        order = np.argsort(i, kind="stable")
        i, v = i[order], v[order]
        if index:
            slices, low = slice_block(v)
            body, shape = slices.tobytes(), list(slices.shape)
        else:
            low, body, shape = np.zeros(width, np.int64), v.tobytes(), list(v.shape)
        return pa.RecordBatch.from_pydict({"ids": pa.array([i.tobytes()], pa.binary()), "low": pa.array([low.astype(np.int64).tobytes()], pa.binary()), "body": pa.array([body], pa.binary()), "shape": pa.array([shape], pa.list_(pa.int64())), "n": pa.array([next(made)], pa.int64())})

    for batch in batches:
        for start in range(0, batch.num_rows, size):
            i, v = _rows(batch.slice(start, size), width)
            if ids and sum(map(len, ids)) + len(i) > size:
                yield emit()
                ids, values = [], []
            ids.append(i)
            values.append(v)
    if ids:
        yield emit()


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: tuple[bytes, Sums] | None = None
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            rows = len(ids)
            if held is None or held[0] != r["ids"] + r["body"][:64]:
                held = r["ids"] + r["body"][:64], Sums(np.frombuffer(r["body"], U).reshape(r["shape"]), np.frombuffer(r["low"], np.int64), rows)
            block = held[1]
            queries = np.frombuffer(r["q_body"], np.int64).reshape(r["q_shape"])
            out = []
            for q, query, subsets in zip(np.frombuffer(r["q_ids"], np.int64).tolist(), queries, block.subsets(queries).tolist(), strict=True):
                allowed = block.every
                for i in range(np.searchsorted(ids, q), np.searchsorted(ids, q, "right")):
                    allowed ^= 1 << int(i)
                sums, offset = block.add(query, subsets)
                found = top_rows(sums, allowed, k, rows)
                scores = np.full(len(found), offset % (1 << 64), U)  # modulo 2**64, where the scores of candidates fit
                for w, s in enumerate(sums[:64]):
                    raw = np.frombuffer(s.to_bytes((rows + 7) // 8, "little"), np.uint8)
                    scores += ((raw[found >> 3] >> (found & 7).astype(np.uint8)) & 1).astype(U) << U(w)
                out.append((np.full(len(found), q), ids[found], scores.astype(np.int64)))
            if out:
                q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array(s)})


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, rows: int = 16384, queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product of floor(scale * x) for each query."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), is_query.alias("is_query"))
    finite = F.coalesce(~F.exists("x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))), F.lit(False))
    own = own.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    facts = own.agg(F.max(F.size("x")), F.count("*")).first()
    width, n = facts[0] or 0, facts[1]
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    own = own.select("id", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("v"), "is_query")
    schema = "ids binary, low binary, body binary, shape array<long>, n long"
    index = own.select("id", "v").mapInArrow(lambda b: _blocks(b, width, rows, True), schema)
    asked = own.filter("is_query").select("id", "v").mapInArrow(lambda b: _blocks(b, width, queries, False), schema)
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("body").alias("q_body"), F.col("shape").alias("q_shape"))
    # A stated query set against all rows in blocks: every block of queries goes to each of a few lanes, every block of rows to one.
    # Blocks are dealt in turn to lanes, each of which is a task of its own; every lane gets all queries.
    tasks = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, min(tasks, 2 * math.ceil(n / rows)))
    index = index.withColumn("lane", F.pmod("n", F.lit(lanes)).cast("int")).drop("n").repartitionById(lanes, "lane")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartitionById(lanes, "lane")
    found = index.join(asked, "lane").drop("lane").mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
