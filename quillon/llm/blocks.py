"""Blocks of numbers for an exchange between groups of documents and shards of keys.

A block is one binary value: the sizes of its sections, then the sections'
numbers, all in base 128 with a continuation bit, computed for all blocks at
once.  Where blocks are long enough for it, each is compressed; a first byte
tells.  Only blocks that hold something are made, so there are never more
blocks than keys, however many groups and shards there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
#: Blocks of fewer bytes on average stay as they are.
WORTH = 256


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all numbers, and the end of each one in them."""
    left = values.astype(U)
    sizes = np.ones(len(left), np.int64)
    top = int(left.max()) if len(left) else 0
    for k in range(7, max(8, top.bit_length()), 7):
        sizes += left >= U(1 << k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, open_ = ends - sizes, np.arange(len(left))
    while len(open_):
        more = left >= U(128)
        out[at] = (left & U(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        open_, at, left = open_[more], at[more] + 1, left[more] >> U(7)
    return out, ends


def decode(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(ends) else ends
    out = (data[starts] & 127).astype(U)
    at, shift = np.flatnonzero(ends > starts), 7
    while len(at):
        out[at] |= (data[starts[at] + shift // 7] & 127).astype(U) << U(shift)
        at, shift = at[ends[at] - starts[at] > shift // 7], shift + 7
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the runs [start, start + size), one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """(block, section): where each section begins when the sections of a block follow its header."""
    blocks, sections = sizes.shape
    each = np.column_stack([np.full(blocks, sections), sizes]).reshape(-1)
    return (np.cumsum(each) - each).reshape(blocks, sections + 1)


def pack(sizes: np.ndarray, sections: list[np.ndarray]) -> pa.Array:
    """One binary value a block.  sizes: (block, section); sections: their numbers, block after block."""
    sizes = sizes.astype(np.int64)
    starts = _starts(sizes)
    values = np.empty(sizes.size + int(sizes.sum()), U)
    values[spread(starts[:, 0], np.full(len(sizes), sizes.shape[1]))] = sizes.reshape(-1).astype(U)
    for s, numbers in enumerate(sections):
        values[spread(starts[:, s + 1], sizes[:, s])] = numbers.astype(U)
    data, ends = encode(values)
    edges = np.concatenate([np.zeros(1, np.int64), ends[starts[:, -1] + sizes[:, -1] - 1]])
    if edges[-1] >= WORTH * len(sizes):
        raw, squeeze, cuts = memoryview(data.tobytes()), zstandard.ZstdCompressor(level=1).compress, edges.tolist()
        return pa.array([b"\1" + squeeze(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
    out = np.zeros(len(data) + len(sizes), np.uint8)
    out[np.arange(len(data)) + 1 + np.repeat(np.arange(len(sizes)), np.diff(edges))] = data
    offsets = (edges + np.arange(len(edges))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def unpack(column: pa.Array | pa.ChunkedArray, sections: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """sizes and sections as they were given to pack."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, sections), np.int64), [np.zeros(0, U) for _ in range(sections)]
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    packed = np.frombuffer(column.buffers()[2], np.uint8)
    if packed[edges[:-1]].any():
        raw, cuts, open_ = memoryview(packed), edges.tolist(), zstandard.ZstdDecompressor().decompress
        blocks = [open_(raw[a + 1 : b]) if raw[a] else bytes(raw[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        data, edges = np.frombuffer(b"".join(blocks), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in blocks])])
    else:
        data, edges = np.delete(packed[edges[0] : edges[-1]], edges[:-1] - edges[0]), edges - edges[0] - np.arange(len(edges))
    values = decode(data)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data < 128, out=before[1:])
    first = before[edges[:-1]]
    sizes = values[first[:, None] + np.arange(sections)].astype(np.int64)
    starts = _starts(sizes)
    return sizes, [values[spread(starts[:, s + 1], sizes[:, s])] for s in range(sections)]


def falls(runs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rising numbers of each run as differences; the first of a run stays.  runs: sizes, none of them 0."""
    out = values.astype(U)
    out[1:] -= values[:-1].astype(U)
    first = np.cumsum(runs) - runs
    out[first] = values[first].astype(U)
    return out


def rises(runs: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The numbers again from their differences."""
    total = np.cumsum(steps, dtype=U)
    first = np.cumsum(runs) - runs
    return total - np.repeat(total[first] - steps[first], runs)
