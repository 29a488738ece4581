"""Vectorised word, line and window tables over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; all of these are
ASCII, so the work is done on UTF-8 bytes with numpy and no Python object is
made per word.  A null text counts as an empty text.  Hashes are 64-bit
polynomials over bytes (words, lines) or over word hashes (windows), finished
with a mixing step; callers that need more than 64 bits use two bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE, ALT_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xF1357AEA2E62A9C5)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the longest table asked for is kept."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(base), -1, 1 << 64)
        up, down = np.full(size, base, U), np.full(size, U(inverse), U)
        up[0] = down[0] = 1
        have = _powers[int(base)] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of values[starts:ends] for every span, equal for equal contents wherever they stand."""
    up, down = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * up[: len(values)], out=prefix[1:])
    span = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(span ^ ((ends - starts).astype(U) * U(0xA24BAED4963EE407)))


@dataclass
class Texts:
    """Bytes of several texts one after another; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def boundaries(self, hit: np.ndarray) -> np.ndarray:
        """How many True of hit lie in each text."""
        total = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=total[1:])
        return np.diff(total[self.offsets])


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so that a numpy table stays small."""
    if not batch.num_rows:
        return
    lengths = np.diff(texts_of(batch.column(text)).offsets)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most, prepend=0))
    edges = [0, *[int(c) for c in cuts if c], batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of Texts: byte spans, the first word of each text (with an end entry) and hashes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def window_starts(self, n: int) -> np.ndarray:
        """Indices of the words at which a window of n words of one text starts."""
        left = np.repeat(self.first[1:], self.per_text) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)

    def windows(self, n: int, base: np.uint64 = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        at = self.window_starts(n)
        return at, spans_hash(self.hashes, at, at + n, base)


def words_of(texts: Texts, lower: bool = False) -> Words:
    data = texts.data
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.flatnonzero(np.diff(texts.offsets))
    before[texts.offsets[filled]] = False
    after[texts.offsets[filled + 1] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes = spans_hash(data.astype(U), starts, ends, BYTE_BASE)
    return Words(starts, ends, np.searchsorted(starts, texts.offsets), hashes)


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of `size` positions lie in a window [s, s + n) of some s in starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1) if len(starts) < 1000 else edge.__iadd__(np.bincount(starts, minlength=size + 1))
    edge[n:] -= np.bincount(starts, minlength=size + 1)[: size + 1 - n]
    return np.cumsum(edge[:size]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once in the array."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys
