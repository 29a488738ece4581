"""Removal of repeated passages with fixed-block anchors.

The reference blocks are the non-overlapping blocks of `block` words of every
text.  Every rolling window of `block` words probes them: a shard of the hash
range learns which probed sequences occur more than once and are a reference
block somewhere.  With ``2 * block <= window + 1`` each window of `window`
words holds a whole reference block of its earliest occurrence, so every
repeated window has an anchor in it.  Hits are extended: the windows around an
anchor are stated by a second, independent hash together with their first
place, and a window is a repeat if the same sequence starts earlier (smaller
id, or same text and earlier start).  The union of the repeats of a text are
the maximal exact repeats; they are cut out.

Windows of different groups are compared by 80 bits of two hashes, those of one
group by 64: of 10**10 windows near anchors, 10**5 to 10**6 in a group, under
0.0003 pairs of different ones are taken for equal by chance.

Defined results: a null text counts as empty and has nothing to remove; texts
shorter than `window` words stay; of rows with the same id in one group
(dealt by id and text) the smaller text is earlier, in several groups the
smaller start, then the smaller group; a null id is before all others.  Other columns
are not read.
"""

from __future__ import annotations

import json
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

from . import words as W
from .exchange import grouped, in_order, pack_bits, pack_keys, planes, shard_edges, slices, unpack_bits, unpack_keys, unplanes


def _windows(table: pa.Table, size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a group: hashes of their windows, the word index in the text and the row of each."""
    keys, at, row, before = [np.zeros(0, W.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in slices(table):
        words = W.words_of(W.texts_of(part.column("text")))
        start, hashed = words.windows(size, base)
        owner = words.text_of()[start]
        keys.append(hashed)
        at.append(start - words.first[owner])
        row.append(owner + before)
        before += part.num_rows
    return np.concatenate(keys), np.concatenate(at), np.concatenate(row)


def _state_anchors(table: pa.Table, block: int, shards: int) -> pa.Table:
    """A group's probes: distinct window hashes, which are reference blocks, which occur more than once here."""
    keys, at, _ = _windows(in_order(table), block, W.ALT_BASE)
    distinct, counts = np.unique(keys, return_counts=True)
    blocks = np.zeros(len(distinct), bool)
    blocks[np.searchsorted(distinct, keys[at % block == 0])] = True
    rows = [(s, pack_keys(distinct[a:b]), b - a, pack_bits(blocks[a:b]), pack_bits(counts[a:b] > 1)) for s, a, b in shard_edges(distinct, shards)]
    return _table(rows, [("shard", pa.int32()), ("keys", pa.binary()), ("n", pa.int64()), ("blocks", pa.binary()), ("more", pa.binary())], g=table.column("g")[0].as_py())


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]], **fixed: int) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array([v] * len(rows), pa.int32()) for v in fixed.values()] + [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[*fixed, *(n for n, _ in fields)])


def _find_anchors(table: pa.Table) -> pa.Table:
    """A shard's answer to each group: which of its keys are anchors of a repeat."""
    stated = table.to_pydict()
    keys = [unpack_keys(k) for k in stated["keys"]]
    blocks = [unpack_bits(b, n) for b, n in zip(stated["blocks"], stated["n"], strict=True)]
    more = [unpack_bits(b, n) for b, n in zip(stated["more"], stated["n"], strict=True)]
    order = np.sort(np.concatenate(keys))
    twice = np.union1d(order[1:][order[1:] == order[:-1]], np.concatenate([k[m] for k, m in zip(keys, more, strict=True)]))
    anchors = np.intersect1d(twice, np.concatenate([k[b] for k, b in zip(keys, blocks, strict=True)]))
    found = [np.intersect1d(k, anchors, assume_unique=True) for k in keys]
    return _table([(g, pack_keys(f)) for g, f in zip(stated["g"], found, strict=True) if len(f)], [("g", pa.int32()), ("keys", pa.binary())])


def _keys_of(answers: pa.Table) -> np.ndarray:
    """All keys that the shards answered, sorted."""
    return np.sort(np.concatenate([np.zeros(0, W.U), *(unpack_keys(k) for k in answers.column("keys").to_pylist())]))


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys


def _state_windows(table: pa.Table, answers: pa.Table, block: int, window: int, shards: int) -> pa.Table:
    """Windows around a group's anchors: hash, first place, and whether there are more here."""
    anchors = _keys_of(answers)
    fields = [("shard", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("more", pa.binary())]
    if not table.num_rows or not len(anchors):
        return _table([], fields, g=0)
    table = in_order(table)
    keys, checks, ats, rows, before = [], [], [], [], 0
    for part in slices(table):
        words = W.words_of(W.texts_of(part.column("text")))
        start, hashed = words.windows(block, W.ALT_BASE)
        hit = np.zeros(len(words.starts) + 1, np.int64)
        hit[1 + start[_among(hashed, anchors)]] = 1
        hits = np.cumsum(hit)
        at, hashed = words.windows(window)
        near = hits[at + window - block + 1] > hits[at]
        owner = words.text_of()[at[near]]
        keys.append(hashed[near])
        checks.append((W.spans_hash(words.hashes, at[near], at[near] + window, W.ALT_BASE) >> W.U(48)).astype(np.uint16))
        ats.append(at[near] - words.first[owner])
        rows.append(owner + before)
        before += part.num_rows
    key, check, at, row = np.concatenate(keys), np.concatenate(checks), np.concatenate(ats), np.concatenate(rows)
    order = np.lexsort((check, key))  # stable: the first of equals stays the first
    new = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)])) if len(key) else np.zeros(0, np.int64)
    first, counts = order[new], np.diff(np.append(new, len(key)))
    distinct, check = key[first], check[first]
    least = np.iinfo(np.int64).min
    ids = table.column("doc_id").cast(pa.int64()).fill_null(least).to_numpy()[row[first]]
    places = at[first].astype(np.int64)
    out = [(s, pack_keys(distinct[a:b]), planes(check[a:b]), planes(ids[a:b]), planes(places[a:b]), pack_bits(counts[a:b] > 1)) for s, a, b in shard_edges(distinct, shards)]
    return _table(out, fields, g=table.column("g")[0].as_py())


def _find_repeats(table: pa.Table) -> pa.Table:
    """A shard's answer: the windows of each group that start earlier elsewhere, and those of which it has the first and more."""
    stated = table.to_pydict()
    keys = [unpack_keys(k) for k in stated["keys"]]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    ids = np.concatenate([unplanes(b, np.int64) for b in stated["ids"]])
    places = np.concatenate([unplanes(b, np.int64) for b in stated["places"]])
    check = np.concatenate([unplanes(b, np.uint16) for b in stated["checks"]])
    more = np.concatenate([unpack_bits(b, n) for b, n in zip(stated["more"], sizes, strict=True)])
    order = np.lexsort((np.repeat(stated["g"], sizes), places, ids, check, key))
    ranked, checked = key[order], check[order]
    later = np.zeros(len(key), bool)
    later[order[1:]] = (ranked[1:] == ranked[:-1]) & (checked[1:] == checked[:-1])
    rows, edge = [], 0
    for g, k, n in zip(stated["g"], keys, sizes, strict=True):
        gone, own = later[edge : edge + n], more[edge : edge + n]
        edge += n
        for kind, which in ((1, gone), (2, own & ~gone)):
            if which.any():
                rows.append((g, kind, pack_keys(k[which])))
    return _table(rows, [("g", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())])


def _cut(table: pa.Table, answers: pa.Table, window: int, kept_fields: list[pa.Field], verbatim: bool) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), *kept_fields, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
    if not table.num_rows:
        return schema.empty_table()
    kinds = answers.column("kind")
    gone = _keys_of(answers.filter(pc.equal(kinds, 1)))
    first_here = _keys_of(answers.filter(pc.equal(kinds, 2)))
    seen = np.zeros(len(first_here), bool)
    table = in_order(table)
    out = []
    for part in slices(table):
        texts = W.texts_of(part.column("text"))
        words = W.words_of(texts)
        at, hashed = words.windows(window)
        repeat = _among(hashed, gone)
        for i in np.flatnonzero(_among(hashed, first_here)):
            k = np.searchsorted(first_here, hashed[i])
            repeat[i] = seen[k]
            seen[k] = True
        removed = W.covered(len(words.starts), at[repeat], window)
        total = np.concatenate([[0], np.cumsum(removed)])
        per_text = total[words.first[1:]] - total[words.first[:-1]]
        spans, kept = [], []
        for i in range(part.num_rows):
            whole = texts.text(i)
            if verbatim and not per_text[i]:
                spans.append([])
                kept.append(whole.decode("utf-8", "replace"))
                continue
            split = whole.split()
            if per_text[i]:
                flags = removed[words.first[i] : words.first[i + 1]]
                edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                split = compress(split, ~flags)
            else:
                spans.append([])
            kept.append(b" ".join(split).decode("utf-8", "replace"))
        out.append(pa.Table.from_arrays([part.column("doc_id"), *(part.column(f.name) for f in kept_fields), pa.array(words.per_text), pa.array(per_text), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string())], schema=schema))
    return pa.concat_tables(out)


def nullable(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere, as Arrow results come back."""
    return type(kind).fromJson(json.loads(re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', kind.json()))) if isinstance(kind, StructType) else kind


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10, row: Column | None = None, verbatim: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges cut out) and kept_text (the other words, joined by one space).

    row: an expression to carry along as column `row`; verbatim: texts with nothing to cut out stay as they are.
    """
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole reference block wherever it starts")
    kind = None if row is None else nullable(docs.select(row.alias("row")).schema["row"].dataType)
    own, shards = grouped(docs.withColumn(id_col, docs[id_col].cast("long")), id_col, text_col, {} if kind is None else {"row": row.cast(kind)})
    carried = [] if kind is None else [StructField("row", kind)]
    fields = [pa.field("row", to_arrow_type(f.dataType)) for f in carried]
    bare = own.select("g", "doc_id", "text")
    probes = bare.groupBy("g").applyInArrow(lambda t: _state_anchors(t, block, shards), "g int, shard int, keys binary, n long, blocks binary, more binary")
    anchors = probes.groupBy("shard").applyInArrow(_find_anchors, "g int, keys binary")
    stated = bare.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(lambda t, a: _state_windows(t, a, block, window, shards), "g int, shard int, keys binary, checks binary, ids binary, places binary, more binary")
    repeats = stated.groupBy("shard").applyInArrow(_find_repeats, "g int, kind int, keys binary")
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    out = StructType([StructField("doc_id", LongType()), *carried, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(span)), StructField("kept_text", StringType())])
    return own.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(lambda t, a: _cut(t, a, window, fields, verbatim), out)
