"""Elias-Fano coding of monotone sequences and an n-gram trie made of such levels."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

U = np.uint64


#: For each byte and k: the place of its k-th (from 0) set bit.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _places = [_i for _i in range(8) if _byte >> _i & 1]
    _IN_BYTE[_byte, : len(_places)] = _places


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word: its byte by running counts, then a table."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    which = np.minimum((upto <= k.astype(np.uint8)[:, None]).sum(axis=1, dtype=np.int64), 7)
    flat = np.arange(len(parts)) * 8 + which
    before = np.where(which > 0, upto.reshape(-1)[np.maximum(flat - 1, 0)], 0)
    return which * 8 + _IN_BYTE[parts.reshape(-1)[flat], (k - before) & 7]


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words, lowest bit first, with two words to spare."""
    raw = np.packbits(flags, bitorder="little")
    out = np.zeros((len(raw) + 7) // 8 + 2, U)
    out.view(np.uint8)[: len(raw)] = raw
    return out


class EliasFano:
    """A monotone sequence of numbers below `universe`: low bits apart, high parts as unary gaps in a bitmap.

    All methods take arrays of questions.  With `folder` the arrays are files, mapped into memory.
    """

    def __init__(self, values: np.ndarray, universe: int, folder: Path | None = None) -> None:
        n = self.n = len(values)
        self.universe = max(1, int(universe))
        self.low_bits = max(0, (self.universe // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        unary = np.zeros(n + (self.universe >> self.low_bits) + 1, bool)
        unary[(values >> U(self.low_bits)).astype(np.int64) + np.arange(n)] = True
        bits = _packed(unary)
        low = np.zeros((n, self.low_bits), bool)
        for b in range(self.low_bits):
            low[:, b] = values >> U(b) & U(1)
        low = _packed(low.reshape(-1))
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.bits, self.low, self.ones = (self._mapped(a, name, folder) for a, name in ((bits, "bits"), (low, "low"), (counts, "ones")))
        self.zeros = np.arange(len(bits) + 1) * 64 - self.ones

    @staticmethod
    def _mapped(values: np.ndarray, name: str, folder: Path | None) -> np.ndarray:
        if folder is None:
            return values
        folder.mkdir(parents=True, exist_ok=True)
        np.save(folder / f"{name}.npy", values)
        return np.load(folder / f"{name}.npy", mmap_mode="r")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (first | second) & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.bits[word], i - self.ones[word])
        return ((at - i).astype(U) << U(self.low_bits) | self._low(i)).astype(np.int64)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the numbers with a high part: the run of ones after its zero."""
        k = high - 1
        word = np.clip(np.searchsorted(self.zeros, k, "right") - 1, 0, len(self.bits) - 1)
        at = word * 64 + _select_in_word(~self.bits[word], np.maximum(k - self.zeros[word], 0))
        at = np.where(high <= 0, 0, at + 1)
        first = at - np.maximum(high, 0)
        run, open_ = np.zeros(len(high), np.int64), np.arange(len(high))
        while open_.size:  # on into the next word where a run reaches its end
            here = at[open_] + run[open_]
            rest = self.bits[np.minimum(here >> 6, len(self.bits) - 1)] >> (here & 63).astype(U)
            ones = np.bitwise_count(rest ^ (rest + U(1))).astype(np.int64) - 1
            ones = np.minimum(np.where(rest == U(0xFFFFFFFFFFFFFFFF), 64, ones), 64 - (here & 63))
            run[open_] += ones
            open_ = open_[(ones > 0) & (ones == 64 - (here & 63))]
        return first, first + run

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of x in [first, end), or -1: successor search among the numbers with x's high part."""
        x = x.astype(np.int64)
        inside = (x >= 0) & (x < self.universe) & (end > first)
        safe = np.where(inside, x, 0)
        a, b = self._bucket(safe >> self.low_bits)
        a, b = np.maximum(a, first), np.minimum(b, end)
        low = safe.astype(U) & U((1 << self.low_bits) - 1)
        a, b = np.where(inside, a, 0), np.where(inside, np.maximum(b, a), 0)
        last = b.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < low[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
        found = a < last
        found[found] = self._low(a[found]) == low[found]
        return np.where(found, a, -1)


class Siblings:
    """The successors of each context: a monotone pointer per context and ids that rise within its range.

    Ids of one range are stored above the last of the range before, so that the whole level is one monotone sequence.
    """

    def __init__(self, context: np.ndarray, ids: np.ndarray, contexts: int, folder: Path | None = None) -> None:
        counts = np.bincount(context, minlength=contexts)
        pointers = np.concatenate([[0], np.cumsum(counts)])
        last = np.flatnonzero(np.diff(context, append=-1)) if len(context) else np.zeros(0, np.int64)
        base = np.zeros(contexts, np.int64)
        base[context[last]] = ids[last] + 1
        base = np.cumsum(base) - base
        values = base[context] + ids if len(ids) else np.zeros(0, np.int64)
        self.pointers = EliasFano(pointers, len(ids) + 1, folder / "pointers" if folder else None)
        self.ids = EliasFano(values, int(values[-1]) + 1 if len(values) else 1, folder / "ids" if folder else None)

    def find(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The place of each id among the successors of its context; -1: none."""
        out = np.full(len(context), -1)
        known = np.flatnonzero(context >= 0)
        if not self.ids.n or not len(known):
            return out
        asked = context[known]
        new = np.flatnonzero(np.diff(asked, prepend=-1))  # each run of one context looks up its range once
        run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(asked))))
        first, end = self.pointers.access(asked[new]), self.pointers.access(asked[new] + 1)
        base = np.where(first > 0, self.ids.access(np.maximum(first - 1, 0)) + 1, 0)
        out[known] = self.ids.find(base[run] + ids[known], first[run], end[run])
        return out


class Trie:
    """Words, pairs and triples with quantised terms of probabilities, in levels mapped into memory.

    The roots are the first words of the pairs given, a monotone sequence of word numbers; below each are the second
    words, below each pair the third ones.  A code is 1 + 16 * -log10 of a term, 0 for none: of pairs and triples their
    count over their context's count and prior, of pairs also the weight of the shorter context after them.
    The files are in a folder of the task's own and removed with it.
    """

    STEP, MOST = 16, 254

    def __init__(self, first: np.ndarray, second: np.ndarray, context: np.ndarray, third: np.ndarray, two: np.ndarray, three: np.ndarray, one: np.ndarray, priors: tuple[float, float]) -> None:
        """first, second: sorted pairs; context, third: sorted triples by the index of their pair; one: counts of the first words."""
        seen, deep = two > 0, three > 0
        roots, parent = np.unique(first[seen], return_inverse=True)
        place = np.cumsum(seen) - 1
        self.folder = tempfile.TemporaryDirectory(prefix="trie-")
        root = Path(self.folder.name)
        self.roots = EliasFano(roots, int(roots[-1]) + 1 if len(roots) else 1, root / "1")
        self.second = Siblings(parent, second[seen], max(1, len(roots)), root / "2")
        self.third = Siblings(place[context[deep]], third[deep], max(1, int(seen.sum())), root / "3")
        terms = {"pairs": two[seen] / (one[seen] + priors[0]), "weights": priors[1] / (two[seen] + priors[1]), "triples": three[deep] / (two[context[deep]] + priors[1])}
        self.codes = {k: EliasFano._mapped(self.quantised(t), k, root) for k, t in terms.items()}

    @classmethod
    def quantised(cls, term: np.ndarray) -> np.ndarray:
        return (1 + np.clip(np.rint(-np.log10(term) * cls.STEP), 0, cls.MOST)).astype(np.uint8)

    @classmethod
    def value(cls, codes: np.ndarray) -> np.ndarray:
        table = 10.0 ** (-np.arange(-1, cls.MOST + 1) / cls.STEP)
        table[0] = 0
        return table[codes.astype(np.int64)]

    def ask(self, first: np.ndarray, second: np.ndarray, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs, of the weights after them (1, all of it, after unknown ones) and of triples; the questions are sorted."""
        new = np.flatnonzero(np.diff(first, prepend=-1))
        node = np.repeat(self.roots.find(first[new], np.zeros(len(new), np.int64), np.full(len(new), self.roots.n)), np.diff(np.append(new, len(first))))
        pair = self.second.find(node, second)
        triple = self.third.find(pair[context], third)
        pick = lambda name, at, none: np.where(at >= 0, self.codes[name][np.maximum(at, 0)], none) if len(self.codes[name]) else np.full(len(at), none)
        return pick("pairs", pair, 0), pick("weights", pair, 1), pick("triples", triple, 0)

    def __enter__(self) -> Trie:
        return self

    def __exit__(self, *_: object) -> None:
        del self.roots, self.second, self.third, self.codes
        self.folder.cleanup()
