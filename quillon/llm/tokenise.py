"""Byte-level BPE ids of whole texts, encoding each distinct word of a batch once.

A text is cut before every single space between two visible characters.  The
pattern that splits text before the merges never joins across such a place, so
the ids of the parts, one after another, are the ids of the text; added tokens of the
vocabulary, which hold no space, stay whole and get their own ids.  The distinct
parts of a batch are joined and encoded in one call; the byte lengths of the
ids tell where each part ends.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pandas as pd

from . import words as W


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(vocabulary_file: str):
    """The encoder of a byte-level vocabulary with its added tokens, and the byte length of each id."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_file, encoding="utf-8") as file:
        described = json.load(file)
    # Such files write bytes as characters: visible ones as themselves, the others, in order, from U+0100 on.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    added = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added}
    lengths = np.zeros(max(*ranks.values(), *added.values()) + 1, np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
        lengths[i] = len(token)
    return tiktoken.Encoding(os.path.basename(vocabulary_file), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), lengths


def _ids(encoding, raw: bytes) -> np.ndarray:
    return np.array(encoding.encode(raw.decode("utf-8", "replace"), allowed_special="all"), np.uint32)


def _parts(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the parts, and which of them begin a text."""
    data = texts.data
    visible = ~W.SPACE[data] & (data > 0x20)
    # Lead bytes of characters that may be white space, or are rare: not cut around.
    before = visible & (data < 0x80) | (data >= 0x80) & (data < 0xC0)
    wide = np.isin(data, np.array([0xE1, 0xE2, 0xE3], np.uint8))
    odd = data == 0xC2
    after = visible & (data < 0x80) | (data >= 0xC3) & ~wide
    cut = data == 0x20
    for shift in (1, 2, 3):
        bad = np.zeros(len(data), bool)
        bad[shift:] = (odd if shift == 2 else wide if shift == 3 else np.zeros(len(data), bool))[:-shift]
        cut &= ~bad
    ok = np.zeros(len(data), bool)
    ok[1:] = before[:-1]
    cut &= ok
    ok = np.zeros(len(data), bool)
    ok[:-1] = after[1:]
    cut &= ok
    filled = np.flatnonzero(np.diff(texts.offsets))
    heads = texts.offsets[filled]
    cut[texts.offsets[filled + 1] - 1] = False
    cut[heads] = True
    starts = np.flatnonzero(cut)
    head = np.zeros(len(data), bool)
    head[heads] = True
    return starts, head[starts]


def token_ids(texts: W.Texts, vocabulary_file: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the offsets of each text's ids."""
    encoding, lengths = encoder(vocabulary_file)
    if not len(texts.data):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    starts, head = _parts(texts)
    ends = np.append(starts[1:], len(texts.data))
    keys = W.spans_hash(texts.data.astype(W.U), starts, ends, W.BYTE_BASE)
    part, distinct = pd.factorize(keys)
    where = np.zeros(len(distinct), np.int64)
    where[part[::-1]] = np.arange(len(part) - 1, -1, -1)  # where each distinct part stands first
    inner = np.flatnonzero(~head[where])  # distinct parts that begin with their space
    sizes = (ends - starts)[where]
    if len(inner):
        a, n = starts[where[inner]], sizes[inner]
        edges = np.cumsum(n)
        take = np.repeat(a - (edges - n), n) + np.arange(edges[-1])
        joined = _ids(encoding, texts.data[take].tobytes())
        reached = np.cumsum(lengths[joined])
        stops = np.searchsorted(reached, edges)
        if len(joined) and reached[-1] == edges[-1] and np.array_equal(reached[stops], edges):
            flat, first = joined, np.concatenate([[0], stops + 1])
        else:  # bytes that are no text: encode part by part
            each = [_ids(encoding, texts.data[s : s + m].tobytes()) for s, m in zip(a, n, strict=True)]
            flat, first = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    else:
        flat, first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
    heads = np.flatnonzero(head[where])
    more = [_ids(encoding, texts.data[starts[where[i]] : ends[where[i]]].tobytes()) for i in heads]
    begin, count = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    begin[inner], count[inner] = first[:-1], np.diff(first)
    if more:
        size = np.array([len(x) for x in more])
        begin[heads], count[heads] = len(flat) + np.cumsum(size) - size, size
        flat = np.concatenate([flat, *more])
    n = count[part]
    edges = np.cumsum(n)
    out = flat[np.repeat(begin[part] - (edges - n), n) + np.arange(edges[-1])]
    total = np.concatenate([[0], edges])
    return out, total[np.searchsorted(starts, texts.offsets)]
