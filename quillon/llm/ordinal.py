"""Quality grades by ordinal cumulative-link regression on hashed text features.

With weights w shared by all grades and rising thresholds b_1 < ... < b_K,

    P(grade > k | x) = 1 / (1 + exp(-(w . x - b_{k+1})))    for k = 0 .. K - 1

A text's features are its words, lower-cased and hashed into `buckets` cells
with the logarithm of their counts, and a few measures of its form (share of
symbols, of capitals, of repeated words, marks, line and word lengths).  The
expected grade and the probability of the upper grades select texts.

The fit takes at most `per_class` rated texts of each grade, drawn by a hash of
the id, and runs on the driver; scoring is one pass over whole texts with the
weights (8 bytes a bucket) in the closure.

Defined results: a null or empty text has no words and form measures of 0;
repeated rows are scored one by one; null ratings and ratings of unknown ids
are not used; with fewer than two grades among the ratings every text gets that
grade (0 if there is none).  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .samples import labelled_sample

FORM = 9


@dataclass
class Model:
    weights: np.ndarray
    form: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    centre: np.ndarray
    spread: np.ndarray

    def above(self, features: tuple) -> np.ndarray:
        """P(grade above k) for each text and each k but the last."""
        score = linear(features, self)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def features_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, bucket and value of the hashed words, and the form measures of each text."""
    texts = W.texts_of(column)
    words = W.words_of(texts, lower=True)
    n, owner = len(texts), words.text_of()
    cell, count = np.unique(owner.astype(W.U) * W.U(buckets) + (words.hashes % W.U(buckets)), return_counts=True)
    row, bucket = (cell // W.U(buckets)).astype(np.int64), (cell % W.U(buckets)).astype(np.int64)
    value = np.log1p(count)
    value = value / np.sqrt(np.bincount(row, value**2, n))[row]
    data = texts.data
    total = np.maximum(np.diff(texts.offsets), 1)
    size = np.maximum(words.per_text, 1)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    within = lambda hit, by: texts.boundaries(hit) / by
    at, windows = words.windows(8)
    twice = W.covered(len(words.starts), at[W.repeated(windows ^ W.mix(owner[at].astype(W.U)))], 8)
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    form = np.column_stack([
        within(np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8)), size), within(data == ord("|"), size), within(data == ord("!"), size),
        within((data >= 65) & (data <= 90), total), np.bincount(owner, same, n) / size, np.bincount(owner, twice, n) / size,
        np.bincount(owner, np.isin(last, np.frombuffer(b".?!", np.uint8)), n) / size, np.log1p(words.per_text) / 10, within(data == 10, size),
    ])
    return row, bucket, value, form


def linear(features: tuple, model: Model) -> np.ndarray:
    row, bucket, value, form = features
    return np.bincount(row, value * model.weights[bucket], len(form)) + ((form - model.centre) / model.spread) @ model.form


def fit(samples: list[tuple[int, int, str]], sizes: dict[int, int], buckets: int = 1 << 16, ridge: float = 3e-4, steps: int = 300, rate: float = 0.05) -> Model:
    """Full-batch Adam on the weighted negative log likelihood; classes weigh as often as they were rated."""
    grades = sorted({g for _, g, _ in samples})
    k = len(grades)
    parts = [features_of(pa.array([t for _, _, t in samples[i : i + 500]]), buckets) for i in range(0, len(samples), 500)]
    form = np.concatenate([p[3] for p in parts]) if parts else np.zeros((0, FORM))
    centre, spread = (form.mean(axis=0), form.std(axis=0) + 1e-6) if len(form) else (np.zeros(FORM), np.ones(FORM))
    model = Model(np.zeros(buckets), np.zeros(FORM), np.zeros(max(0, k - 1)), grades or [0], centre, spread)
    if k < 2:
        return model
    row = np.concatenate([p[0] + 500 * i for i, p in enumerate(parts)])
    bucket, value = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
    y = np.searchsorted(grades, [g for _, g, _ in samples])
    drawn = np.bincount(y, minlength=k)
    weight = np.array([sizes.get(g, 1) for g in grades], float)[y] / drawn[y]
    weight /= weight.sum()
    share = np.cumsum(np.bincount(y, weight, k))[:-1]
    model.thresholds = np.log(share / (1 - share))
    moments: dict[str, list] = {n: [0.0, 0.0] for n in ("weights", "form", "thresholds")}
    features = (row, bucket, value, form)
    scaled = (form - centre) / spread
    for step in range(1, steps + 1):
        above = np.column_stack([np.ones(len(y)), model.above(features), np.zeros(len(y))])  # P(grade index >= j)
        p = np.maximum(above[np.arange(len(y)), y] - above[np.arange(len(y)), y + 1], 1e-12)
        slope = above * (1 - above)
        upper, lower = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        d = -weight * (upper - lower) / p  # by the linear score
        by_threshold = np.zeros(k + 1)
        np.add.at(by_threshold, y, weight * upper / p)
        np.add.at(by_threshold, y + 1, -weight * lower / p)
        gradients = {"weights": np.bincount(bucket, value * d[row], buckets) + ridge * model.weights, "form": scaled.T @ d + ridge * model.form, "thresholds": by_threshold[1:k]}
        for name, g in gradients.items():
            m = moments[name]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
            setattr(model, name, getattr(model, name) - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        model.thresholds = np.maximum.accumulate(model.thresholds)
    return model


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: list[int], allowed: Column | None = None, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from rated rows; `grade` is an expression over the ratings, `allowed` one over id."""
    return fit(*labelled_sample(docs, ratings, grade, F.lit(True) if allowed is None else allowed, per_class, grades, id_col, text_col))


def grade_texts(docs: DataFrame, model: Model, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_prob (of a grade of at least `tail`) and the most likely grade."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    buckets, grades = len(model.weights), np.array(model.grades, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch):
                above = np.column_stack([np.ones(part.num_rows), model.above(features_of(part.column("text"), buckets)), np.zeros(part.num_rows)])
                each = above[:, :-1] - above[:, 1:]
                at = int(np.searchsorted(grades, tail))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "expected_grade": pa.array(each @ grades), "tail_prob": pa.array(above[:, at] if at < len(grades) else np.zeros(part.num_rows)), "grade": pa.array(grades[each.argmax(axis=1)].astype(np.int32))})

    return own.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double, grade int")
