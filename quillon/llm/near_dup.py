"""Near-duplicates by BagMinHash signatures of word-shingle multisets, bands and exact verification.

A text is the multiset of its shingles of `words` words (all its words at once,
if it has fewer).  For a shingle of weight w the levels (0, w] carry a Poisson
process of points, each with a time, a level and one of the signature's
components; a component keeps the earliest of its points.  The levels are cut
into dyadic rings (0, 1], (1, 2], (2, 4], ..., each with its own generator; a
ring that reaches beyond w is thinned to the levels below.  Two texts agree in
a component with a probability of exactly their weighted Jaccard similarity.
Points are generated in order of time up to a time by which all components are
filled, so the work is about m log m + n for a text of n shingles.

Texts that agree in a whole band are candidates.  They are verified exactly by
multiset overlap, first against one hub per bucket, so that a bucket of copies
costs as many pairs as it has texts; then, for the classes which that leaves
apart in a bucket, blocks of members of different classes are compared within
a task, which returns only the links.  Nothing is capped.

Defined results: equal texts are one class without more ado; a null text counts
as empty; texts without words are like none but equal texts; a class is named
by its smallest id (null if it has no other), repeated rows stay.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .session import written


#: A text with more than this share of the rows is a hot one.
HOT_PARTS = 1000


def shingles_of(texts: W.Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of the distinct shingles of each text, by text and hash."""
    words = W.words_of(texts)
    at, hashes = words.windows(size)
    owner = words.text_of()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < size))
    whole = W.spans_hash(words.hashes, words.first[short], words.first[short + 1], W.WORD_BASE)
    owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[new], hashes[new], np.diff(np.append(new, len(owner)))


def shingles_by_slices(column: pa.Array | pa.ChunkedArray, size: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingles_of, in slices of about `most` bytes, so that byte tables stay small."""
    parts, before = [], 0
    for chunk in pa.table({"text": column}).combine_chunks().to_batches():
        for part in W.pieces(chunk, most=most):
            owner, hashes, counts = shingles_of(W.texts_of(part.column("text")), size)
            parts.append((owner + before, hashes, counts))
            before += part.num_rows
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, W.U), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, m: int) -> np.ndarray:
    """A BagMinHash signature of m components for every text; 0 where a text has no shingle."""
    out = np.zeros((texts, m), W.U)
    weight = np.bincount(owner, counts, texts)
    todo, margin = weight > 0, 7.0
    while todo.any():
        until = (np.log(m) + margin) / np.maximum(weight, 1)
        best = np.full(texts * m, np.inf)
        chosen = np.zeros(texts * m, W.U)
        ring, low = 0, 0
        while (live := np.flatnonzero(todo[owner] & (counts > low))).size:
            width = max(1, low)
            doc, w = owner[live], counts[live]
            state = W.mix(hashes[live] ^ W.mix(np.full(1, 0x5EED + ring, W.U)))
            time = np.zeros(len(live))
            points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(state):
                state = W.mix(state)
                time = time - np.log(((state >> W.U(11)).astype(float) + 0.5) * 2.0**-53) / (m * width)
                go = time <= until[doc]
                doc, w, state, time = doc[go], w[go], state[go], time[go]
                draw = W.mix(state ^ W.U(0xC0FFEE))
                take = low + 1 + ((draw >> W.U(32)).astype(float) * 2.0**-32 * width).astype(np.int64) <= w
                points.append((doc[take] * m + (draw[take] & W.U(0xFFFFFFFF)).astype(np.int64) % m, time[take], state[take]))
            cell, when, point = (np.concatenate(x) for x in zip(*points, strict=True))
            order = np.argsort(-when, kind="stable")
            cell, when, point = cell[order], when[order], point[order]
            first = np.full(texts * m, -1)
            first[cell] = np.arange(len(cell))  # the last to be put is the earliest
            has = np.flatnonzero(first >= 0)
            sooner = has[when[first[has]] < best[has]]
            best[sooner], chosen[sooner] = when[first[sooner]], point[first[sooner]]
            ring, low = ring + 1, max(1, 2 * low)
        filled = np.isfinite(best).reshape(texts, m).all(axis=1) & todo
        out[filled] = chosen.reshape(texts, m)[filled]
        todo &= ~filled
        margin *= 2
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of `rows` components."""
    m = signature.shape[1] // rows
    key = np.broadcast_to(W.mix(np.arange(m).astype(W.U)), (len(signature), m)).copy()
    for r in range(rows):
        key = W.mix(key * W.WORD_BASE ^ signature[:, r::rows][:, :m])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch):
            texts = W.texts_of(part.column("text"))
            owner, hashes, counts = shingles_of(texts, size)
            keys = band_keys(signatures(owner, hashes, counts, len(texts), bands * rows), rows)
            has = np.bincount(owner, minlength=len(texts)) > 0
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "key": part.column("key"), "size": pa.array(np.diff(texts.offsets)), "bands": pa.array([k if h else None for k, h in zip(keys.tolist(), has, strict=True)], pa.list_(pa.int64()))})


def _verify(batches: Iterator[pa.RecordBatch], size: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs whose multiset overlap is at least share[0] / share[1] of their union; the shingles of a hub are kept while it lasts."""
    held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in W.pieces(batch, "text_b", 500_000):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            new = [i for i in range(len(a)) if (i == 0 or a[i] != a[i - 1]) and a[i] not in held]
            held = {k: v for k, v in held.items() if k == a[0]}
            new = [i for i in range(len(a)) if (i == 0 or a[i] != a[i - 1]) and a[i] not in held]
            for column, names, rows, keep in (("text_a", a, new, held), ("text_b", b, range(len(b)), others := {})):
                owner, hashes, counts = shingles_by_slices(part.column(column).take(pa.array(list(rows), pa.int64())), size)
                edges = np.searchsorted(owner, np.arange(len(rows) + 1))
                for j, i in enumerate(rows):
                    keep[names[i]] = hashes[edges[j] : edges[j + 1]], counts[edges[j] : edges[j + 1]]
            same = []
            for x, y in zip(a, b, strict=True):
                (ha, ca), (hb, cb) = held[x], others[y]
                at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
                hit = ha[at] == hb
                shared = int(np.minimum(ca[at[hit]], cb[hit]).sum())
                same.append(shared * share[1] >= share[0] * (int(ca.sum()) + int(cb.sum()) - shared))
            yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "same": pa.array(same, pa.bool_())})


def _links(table: pa.Table, size: int, share: tuple[int, int]) -> pa.Table:
    """Links between texts of different classes in one block of a bucket: few (side 0) against many (side 1).

    The shingles of the many are sorted once; those of each of the few are looked up there and overlaps added up.
    A pair that shares several bands is judged in the first of them.
    """
    few, many = (table.filter(pc.equal(table.column("side"), s)) for s in (0, 1))
    found: list[tuple[bytes, bytes]] = []
    joined: set[tuple[bytes, bytes]] = set()
    if few.num_rows and many.num_rows:
        band = table.column("band")[0].as_py()
        owner, hashes, counts = shingles_by_slices(many.column("text"), size)
        total = np.bincount(owner, counts, many.num_rows)
        order = np.argsort(hashes, kind="stable")
        owner, hashes, counts = owner[order], hashes[order], counts[order]
        keys, labels = many.column("key").to_pylist(), np.array(many.column("label").to_pylist(), object)
        main = np.array(many.column("main").to_pylist(), bool)
        bands = np.array(many.column("bands").to_pylist(), np.int64)
        own, own_hashes, own_counts = shingles_by_slices(few.column("text"), size)
        edges = np.searchsorted(own, np.arange(few.num_rows + 1))
        for i, (key, label, own_bands) in enumerate(zip(few.column("key").to_pylist(), few.column("label").to_pylist(), few.column("bands").to_pylist(), strict=True)):
            h, c = own_hashes[edges[i] : edges[i + 1]], own_counts[edges[i] : edges[i + 1]]
            first, end = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            n = end - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], np.minimum(counts[at], np.repeat(c, n)), many.num_rows)
            close = shared * share[1] >= share[0] * (total + c.sum() - shared)
            here = (bands == np.array(own_bands, np.int64)).argmax(axis=1) == band
            for j in np.flatnonzero(close & here & (labels != label)):
                if (main[j] or key < keys[j]) and (label, labels[j]) not in joined:  # one link joins two classes
                    joined.add((label, labels[j]))
                    found.append((min(key, keys[j]), max(key, keys[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5), bands: int = 24, rows: int = 4, hubs: int = 3, block: int = 1024, block_bytes: int = 16_000_000, with_key: bool = False) -> DataFrame:
    """doc_id, class_id: the smallest id of each document's class; with_key: also key, the text's MD5, and class_key, a key of the class."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("key", F.unhex(F.md5("text")))
    kind = own.schema["doc_id"].dataType.simpleString()
    signed = written(own.mapInArrow(lambda b: _sign(b, words, bands, rows), f"doc_id {kind}, key binary, size long, bands array<long>"), "near-signed")
    distinct = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("copies"))
    spread = distinct.filter(F.col("bands").isNotNull()).select("key", "size", F.posexplode("bands").alias("band", "value"))
    full = spread.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").select("band", "value")
    members = written(spread.join(full, ["band", "value"]), "near-members")
    named = members.select("key").distinct()
    # One text of each key, found by the id too, so that copies under other ids go to other tasks.
    chosen = distinct.join(named, "key").select(F.col("key").alias("of_key"), F.col("doc_id").alias("of_id"))
    found = own.join(chosen, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    texts = written(found.groupBy("key").agg(F.first("text").alias("text")), "near-texts")

    def hub_pairs(labelled: DataFrame, seed: int) -> DataFrame:
        """One text of each bucket with all others there that are not of its class."""
        order = F.struct(F.xxhash64(F.lit(seed), "key"), "key", "label")
        hub = labelled.groupBy("band", "value").agg(F.min(order).alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
        found = labelled.join(hub, ["band", "value"]).filter(F.col("label") != F.col("hub.label"))
        return found.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b")]
        both = pairs.join(sides[1], "b").join(sides[0], "a")
        return both.select("a", "text_a", "b", "text_b").mapInArrow(lambda b: _verify(b, words, share), "a binary, b binary, same boolean")

    def rest(labelled: DataFrame) -> DataFrame:
        """Links between all texts of different classes in a bucket, in blocks of a bucket's members."""
        sizes = labelled.groupBy("band", "value", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("band", "value").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels"))
        parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / block_bytes)).cast("int")
        apart = sizes.filter("labels > 1").select("band", "value", F.col("main.label").alias("main_label"), parts(F.col("n"), F.col("size")).alias("many"), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("few"))
        left = labelled.join(apart, ["band", "value"]).withColumn("main", F.col("label") == F.col("main_label"))
        deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["band", "value", "key", "label", "main"]
        many = left.withColumn("i", deal("many")).withColumn("j", all_("few")).select(*columns, "i", "j", F.lit(1).alias("side"))
        few = left.filter(~F.col("main")).withColumn("j", deal("few")).withColumn("i", all_("many")).select(*columns, "i", "j", F.lit(0).alias("side"))
        held = texts.join(distinct.select("key", "bands"), "key")
        blocks = many.unionByName(few).join(held, "key")
        return blocks.groupBy("band", "value", "i", "j").applyInArrow(lambda t: _links(t, words, share), "a binary, b binary").distinct()

    # Pairs with a hub of each bucket, some rounds with other hubs; then all that is left between the classes of a bucket.
    tested, label = None, named.select("key", F.col("key").alias("label"))
    for turn in range(hubs):
        pairs = hub_pairs(members.join(label, "key"), turn)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        now = written(verified(pairs), "near-tested")
        tested = now if tested is None else tested.unionByName(now)
        if now.isEmpty():
            break
        label = components(named, tested.filter("same").select("a", "b"), "key")
    links = written(rest(members.join(label, "key")), "near-links").unionByName(tested.filter("same").select("a", "b"))
    label = components(named, links, "key")

    by_label = distinct.select("key", "doc_id").join(label, "key").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    by_key = label.join(by_label, "label")
    of_key = distinct.select("key", "copies", F.col("doc_id").alias("least_id")).join(by_key, "key", "left").select("key", "copies", F.coalesce("class_id", "least_id").alias("class_id"), F.coalesce("label", "key").alias("class_key"))
    of_key = written(of_key, "near-keys")
    # Rows of a text with very many copies do not meet in one task: there are fewer than HOT_PARTS such texts, and they are broadcast.
    hot = signed.count() / HOT_PARTS
    few, rest_ = of_key.filter(F.col("copies") > hot), of_key.filter(F.col("copies") <= hot)
    rows_ = signed.select("doc_id", "key").join(F.broadcast(few.select("key", F.col("class_id").alias("hot_id"), F.col("class_key").alias("hot_class"))), "key", "left")
    columns = ["doc_id", "class_id", "key", "class_key"] if with_key else ["doc_id", "class_id"]
    hot_rows = rows_.filter(F.col("hot_class").isNotNull()).select("doc_id", "key", F.col("hot_id").alias("class_id"), F.col("hot_class").alias("class_key"))
    other = rows_.filter(F.col("hot_class").isNull()).select("doc_id", "key").join(rest_.drop("copies"), "key")
    return hot_rows.select(*columns).unionByName(other.select(*columns))
