"""Connected components of an undirected graph: of few edges in one task, of more by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ARROW_ROWS, written

#: Edges, each in both directions, that one task holds: 13 MB of 16-byte keys.
AT_ONCE = 400_000


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key with the smallest of its component, of all edges; roots are hung below smaller ones until no edge joins two."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    keys = pc.unique(edges.column("a"))
    keys = keys.take(pc.sort_indices(keys))
    a, b = (pc.index_in(edges.column(c), keys).to_numpy() for c in ("a", "b"))
    root = np.arange(len(keys))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    yield from pa.table({"k": keys, "label": keys.take(pa.array(root))}).to_batches(ARROW_ROWS)


def components(nodes: DataFrame, edges: DataFrame, key: str, at_once: int = AT_ONCE) -> DataFrame:
    """(key, label) for all nodes: the smallest key of each one's component.  edges: two columns of keys, a and b.

    Up to `at_once` edges go to one task.  Of more, every round takes the least label among neighbours, then the
    label of that label; written after each round.  Both give the same labels.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = _at_once(both) if both.count() <= at_once else _by_rounds(both)
    return nodes.join(label.withColumnRenamed("k", key), key, "left").select(key, F.coalesce("label", key).alias("label"))


def _at_once(both: DataFrame) -> DataFrame:
    kind = both.schema["a"].dataType.simpleString()
    return written(both.coalesce(1).mapInArrow(_labels, f"k {kind}, label {kind}"), "labels")


def _by_rounds(both: DataFrame) -> DataFrame:
    label = written(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("k")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("near"))
        lower = label.join(near, "k").select("k", "label", F.least("label", "near").alias("low"))
        above = label.select(F.col("k").alias("low"), F.col("label").alias("above"))
        after = written(lower.join(above, "low", "left").select("k", F.col("label").alias("before"), F.least("low", F.coalesce("above", "low")).alias("label")), "labels")
        label = after.select("k", "label")
        if after.filter("label < before").isEmpty():
            return label
