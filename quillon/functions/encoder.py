"""A sentence encoder of the published BERT kind in numpy: WordPiece, safetensors, forward pass, mean pooling.

No weights come with this package; `Encoder.load` reads a folder with vocab.txt
and model.safetensors.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def _is_punctuation(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c).startswith("P")


def _is_cjk(c: str) -> bool:
    n = ord(c)
    return any(a <= n <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


class WordPiece:
    """Lower-cased, unaccented words split at punctuation, then the longest pieces of the vocabulary from the left."""

    def __init__(self, vocabulary: Sequence[str], limit: int = 256, longest_word: int = 100) -> None:
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.limit, self.longest_word = limit, longest_word
        self.start, self.end, self.unknown, self.pad = (self.ids[t] for t in ("[CLS]", "[SEP]", "[UNK]", "[PAD]"))

    @staticmethod
    def words(text: str) -> list[str]:
        out: list[str] = []
        for c in unicodedata.normalize("NFD", text.lower()):
            kind = unicodedata.category(c)
            if kind == "Mn" or c in "\0�" or kind.startswith("C") and not c.isspace():
                continue
            out.append(f" {c} " if _is_punctuation(c) or _is_cjk(c) else c)
        return "".join(out).split()

    def pieces(self, word: str) -> list[int]:
        if len(word) > self.longest_word:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.ids:
                    out.append(self.ids[piece])
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def encode(self, text: str) -> list[int]:
        inner = [i for w in self.words(text) for i in self.pieces(w)]
        return [self.start, *inner[: self.limit - 2], self.end]


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors of F32 and F16 type, as float32."""
    with open(path, "rb") as f:
        raw = f.read()
    size = int.from_bytes(raw[:8], "little")
    header = json.loads(raw[8 : 8 + size])
    kinds = {"F32": np.float32, "F16": np.float16}
    out = {}
    for name, entry in header.items():
        if name == "__metadata__" or entry["dtype"] not in kinds:
            continue
        a, b = entry["data_offsets"]
        out[name] = np.frombuffer(raw[8 + size + a : 8 + size + b], kinds[entry["dtype"]]).reshape(entry["shape"]).astype(np.float32)
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + eps) * weight + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Encoder:
    """Batched forward pass; all texts of a batch are padded to the longest."""

    tokenizer: WordPiece
    weights: dict[str, np.ndarray]
    heads: int = 12
    layers: int = 6

    @classmethod
    def load(cls, folder: str, **more: int) -> Encoder:
        with open(f"{folder}/vocab.txt", encoding="utf-8") as f:
            vocabulary = f.read().splitlines()
        return cls(WordPiece(vocabulary), read_safetensors(f"{folder}/model.safetensors"), **more)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T + self.weights[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(x, self.weights[f"{name}.weight"], self.weights[f"{name}.bias"])

    def _attention(self, x: np.ndarray, mask: np.ndarray, name: str) -> np.ndarray:
        n, length, width = x.shape
        split = lambda y: y.reshape(n, length, self.heads, width // self.heads).transpose(0, 2, 1, 3)
        q, k, v = (split(self._linear(x, f"{name}.self.{part}")) for part in ("query", "key", "value"))
        scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(width // self.heads) + np.where(mask, 0, -1e9)[:, None, None, :]
        mixed = (softmax(scores) @ v).transpose(0, 2, 1, 3).reshape(n, length, width)
        return self._norm(x + self._linear(mixed, f"{name}.output.dense"), f"{name}.output.LayerNorm")

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """One unit vector a text."""
        ids = [self.tokenizer.encode(t or "") for t in texts]
        longest = max(map(len, ids), default=0)
        if not longest:
            return np.zeros((0, self.weights["embeddings.word_embeddings.weight"].shape[1]), np.float32)
        padded = np.array([i + [self.tokenizer.pad] * (longest - len(i)) for i in ids])
        mask = np.arange(longest)[None, :] < np.array([len(i) for i in ids])[:, None]
        w = self.weights
        x = w["embeddings.word_embeddings.weight"][padded] + w["embeddings.position_embeddings.weight"][:longest] + w["embeddings.token_type_embeddings.weight"][0]
        x = self._norm(x, "embeddings.LayerNorm")
        for i in range(self.layers):
            x = self._attention(x, mask, f"encoder.layer.{i}.attention")
            inner = gelu(self._linear(x, f"encoder.layer.{i}.intermediate.dense"))
            x = self._norm(x + self._linear(inner, f"encoder.layer.{i}.output.dense"), f"encoder.layer.{i}.output.LayerNorm")
        pooled = (x * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
        return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)).astype(np.float32)
