"""Toxicity by compression distance: two trained zstandard dictionaries, window by window.

Both dictionaries come from zstandard's trainer: the ordinary one from windows
of ordinary training texts, the toxic one from the stretches of toxic training
texts whose byte n-grams are far more frequent there than in ordinary ones (the
rest of a toxic text is ordinary prose, and a dictionary of it would say
nothing).  Every window of a text is compressed with the ordinary dictionary
and with the toxic one laid over it, so that what both know cancels out; where
the second is shorter, the window holds toxic material.  How many windows pass
each of a row of thresholds of that difference, and the number of windows, give
the score.  The weights of the thresholds are calibrated on texts that the
dictionaries used for them have not seen: training texts are dealt into folds,
and each fold is measured with dictionaries of the others.

The fit takes at most `per_class` labelled texts and `train_bytes` bytes of
each class, drawn by a hash of the id.  Scoring is one pass over whole texts.

Defined results: a null or empty text is one empty window; repeated rows are
scored one by one; labels other than 0 and 1 and labels of unknown ids are not
used, an id labelled both ways counts as ordinary; with fewer than two texts of
a class among the labels every score is the share of toxic labels.  Other
columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import words as W
from .samples import fold_of, labelled_rows

GRAM, THRESHOLDS = 8, 12


@dataclass(frozen=True)
class Settings:
    """Bounds and limits of the fit."""

    train_bytes: int = 12_000_000
    support: float = 0.01
    least: int = 4
    ratio: float = 40.0
    ordinary_size: int = 32768
    toxic_size: int = 8192
    window: int = 32
    stride: int = 16
    folds: int = 4


@dataclass
class Model:
    """Dictionaries, window sizes and the calibrated weights."""

    ordinary: bytes
    toxic: bytes
    window: int = 32
    stride: int = 16
    level: int = 3
    centre: np.ndarray = field(default_factory=lambda: np.zeros(THRESHOLDS + 3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(THRESHOLDS + 4))

    def compressors(self):
        out = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            if len(content) < 8:
                out.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False).compress)
                continue
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=False, write_checksum=False).compress)
        return out

    def features(self, text: bytes, plain, laid) -> list[float]:
        w, s = self.window, self.stride
        gains = np.array([len(plain(p)) - len(laid(p)) for p in (text[i : i + w] for i in range(0, max(1, len(text) - s), s))])
        passed = np.log1p((gains[:, None] > np.arange(1, THRESHOLDS + 1)).sum(axis=0))
        return [*passed, np.log(len(gains)), float(gains.max()), float(gains.mean())]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (features - self.centre) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grams(text: bytes) -> np.ndarray:
    """Distinct byte n-grams of a text, as numbers."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.unique(sum(raw[i : n + i] << (8 * (GRAM - 1 - i)) for i in range(GRAM)))


def _without_copies(texts: list[bytes], span: int = 24) -> list[bytes]:
    """One text of each set of copies: copies share most of four least hashes of their `span`-byte windows."""
    seen: list[set[int]] = [set() for _ in range(4)]
    kept = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8).astype(W.U)
        at = np.arange(max(1, len(raw) - span + 1))
        keys = W.spans_hash(raw, at, np.minimum(at + span, len(raw)), W.BYTE_BASE)
        least = [int(W.mix(keys ^ W.U(k)).min()) for k in range(4)]
        if sum(v in s for v, s in zip(least, seen, strict=True)) < 2:
            kept.append(text)
        for v, s in zip(least, seen, strict=True):
            s.add(v)
    return kept


def _stretches(text: bytes, marks: np.ndarray) -> list[bytes]:
    """Maximal stretches of a text that are covered by marked n-grams."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    n = len(raw) - GRAM + 1
    if n <= 0 or not len(marks):
        return []
    keys = sum(raw[i : n + i] << (8 * (GRAM - 1 - i)) for i in range(GRAM))
    at = np.minimum(np.searchsorted(marks, keys), len(marks) - 1)
    inside = W.covered(len(raw), np.flatnonzero(marks[at] == keys), GRAM)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary trained on samples; of too little text to train on, the text itself."""
    held = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(1024, min(size, held // 4)), samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def _marks(toxic: list[bytes], ordinary: list[bytes], support: float, least: int, ratio: float) -> np.ndarray:
    """n-grams that stand in at least a share of the toxic texts and far more often than in ordinary ones."""
    seen, count = np.unique(np.concatenate([np.zeros(0, np.int64), *map(_grams, toxic)]), return_counts=True)
    often = count >= max(least, support * len(toxic))
    seen, count = seen[often], count[often]
    other, by_other = np.unique(np.concatenate([np.full(1, np.iinfo(np.int64).max), *map(_grams, ordinary)]), return_counts=True)
    at = np.minimum(np.searchsorted(other, seen), len(other) - 1)
    plain = np.where(other[at] == seen, by_other[at], 0)
    return seen[count / len(toxic) > ratio * (plain + 0.5) / max(1, len(ordinary))]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> tuple[bytes, bytes]:
    """The trained ordinary and toxic dictionaries."""
    marks = _marks(toxic, ordinary, s.support, s.least, s.ratio)
    told = [x for x in (_stretches(t, marks) for t in toxic) if x]
    windows = [t[i : i + 4 * s.window] for t in ordinary for i in range(0, max(1, len(t)), 4 * s.window)]
    return _trained(windows, s.ordinary_size, 64), _trained([b" ".join(x) for x in told], s.toxic_size, 16) if told else b""


def _fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(samples: list[tuple[int, int, str]], sizes: dict[int, int], settings: Settings = Settings()) -> Model:
    """A model from (id, label, text) samples; sizes: how many labels each class has in all."""
    s = settings
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for label in (0, 1):
        total = 0
        for _, y, text in samples:
            raw = text.encode("utf-8", "replace")
            if y == label and total + len(raw) <= s.train_bytes:
                texts[label].append(raw)
                total += len(raw)
        texts[label] = _without_copies(texts[label])
    if min(len(texts[0]), len(texts[1])) < 2:
        model = Model(b"", b"", s.window, s.stride)
        share = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
        model.weights[0] = np.log(share / (1 - share))
        return model
    # Every text is measured with dictionaries of the other folds; the model's own are of all folds.
    x, y = [], []
    for fold in range(s.folds):
        other = {k: [t for i, t in enumerate(v) if i % s.folds != fold] or v for k, v in texts.items()}
        part = Model(*dictionaries(other[1], other[0], s), s.window, s.stride)
        plain, laid = part.compressors()
        for k, v in texts.items():
            own = v[fold :: s.folds]
            x += [part.features(t, plain, laid) for t in own]
            y += [float(k)] * len(own)
    model = Model(*dictionaries(texts[1], texts[0], s), s.window, s.stride)
    x, y = np.array(x), np.array(y)
    weight = np.where(y > 0, sizes.get(1, 1) / (y > 0).sum(), sizes.get(0, 1) / (y == 0).sum())
    weight *= len(y) / weight.sum()
    model.centre = x.mean(axis=0)
    spread = x.std(axis=0) + 1e-9
    w = _fit_weights((x - model.centre) / spread, y, weight, 1e-3)
    model.weights = np.concatenate([w[:1], w[1:] / spread])
    return model


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows whose crc32(id) mod fold is not 0; fitted in one task, so that only the model comes to the driver."""
    allowed = fold_of("id", fold) != 0
    rows, sizes = labelled_rows(docs, labels, F.col(label_col).cast("int"), allowed, per_class, [0, 1], id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted((r["id"], int(r["label"]), r["text"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(samples, sizes))], pa.binary())})

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], sizes)  # of an empty frame Spark may run no task


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id as doc_id, the columns to keep, and score, predicted."""
    keep = keep or []
    own = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_scored"))
    schema = StructType([*own.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, laid = model.compressors()
        for batch in batches:
            texts = W.texts_of(batch.column(batch.num_columns - 1))
            x = np.array([model.features(texts.text(i), plain, laid) for i in range(len(texts))]).reshape(len(texts), -1)
            scores = model.score(x) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return own.mapInArrow(run, schema)
