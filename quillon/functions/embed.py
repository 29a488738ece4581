"""Embedding providers: a registry, a deterministic mock, and embedding of whole columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIMENSION = 384
_MASK128, _MASK64 = (1 << 128) - 1, (1 << 64) - 1
# Multiplier and increment of the 128-bit generator, multiplier of its output step.
_STEP = 47026247687942121848144207491837523525
_ADD = 117397592171526113268558934119004209487
_OUT = 0xDA942042E4DD58B5


class Pcg:
    """The PCG-DXSM generator with a 128-bit state."""

    def __init__(self, high: int, low: int) -> None:
        self.state = (high << 64) | low

    def next(self) -> int:
        self.state = (self.state * _STEP + _ADD) & _MASK128
        high, low = self.state >> 64, self.state & _MASK64
        high ^= high >> 32
        high = high * _OUT & _MASK64
        high ^= high >> 48
        return high * (low | 1) & _MASK64

    def uniform(self) -> float:
        return (self.next() << 11 & _MASK64) / (1 << 11) / (1 << 53)


def mock(text: str) -> np.ndarray:
    """A unit vector that depends on nothing but the text; the empty text gives zeros."""
    if not text:
        return np.zeros(DIMENSION, np.float32)
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    source = Pcg(seed, (seed + 1) & _MASK64)
    out = np.empty(DIMENSION, np.float32)
    for i in range(DIMENSION):
        u, v = source.uniform(), source.uniform()
        out[i] = math.sqrt(-2 * math.log(u if u > 0 else 5e-324)) * math.cos(2 * math.pi * v)
    norm = math.sqrt(float(np.sum(out.astype(float) ** 2)))
    return (out / np.float32(norm)).astype(np.float32) if norm else out


PROVIDERS: dict[str, Callable[[str], np.ndarray]] = {"mock": mock}


def register_provider(name: str, embed: Callable[[str], np.ndarray]) -> None:
    """Make a function of a text known by a name, if it gives vectors of the right length."""
    validate(embed)
    PROVIDERS[name] = embed


def provider(name: str) -> Callable[[str], np.ndarray]:
    if not name:
        raise ValueError("an embedding provider must be named")
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}")
    return PROVIDERS[name]


def validate(embed: Callable[[str], np.ndarray], dimension: int = DIMENSION) -> None:
    if len(vector := embed("probe")) != dimension:
        raise ValueError(f"the provider gives {len(vector)} components; {dimension} are wanted")


def embed_all(rows: DataFrame, name: str, key: str, text_col: str) -> DataFrame:
    """The key and an embedding of each row, a few hundred at a time; vectors leave as one buffer, not as Python numbers."""
    embed = provider(name)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                vectors = np.stack([embed(t.as_py() or "") for t in batch.column(text_col)]).astype(np.float32)
                ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], [key, "embedding"])

    return rows.select(key, text_col).mapInArrow(run, f"{key} {kind}, embedding array<float>")
