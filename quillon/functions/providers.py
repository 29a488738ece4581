"""Embedding providers over HTTP: request shapes, retries and pacing; the transport is passed in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.functions.embed import DIMENSION

#: (url, headers, body) -> (status, headers, body)
Transport = Callable[[str, dict[str, str], bytes], tuple[int, dict[str, str], bytes]]
# Fixed values.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, BATCH = 6, 2.0, 60.0, 96


def normalized(vector: Sequence[float]) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def with_retry(send: Callable[[], tuple[int, dict[str, str], bytes]], wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body of the first success; 429, 5xx and lost connections are tried again, later each time or when told."""
    pause, problem = FIRST_WAIT, "no attempt"
    for attempt in range(ATTEMPTS):
        told = None
        try:
            status, headers, body = send()
            if status < 300:
                return body
            if status != 429 and status < 500:
                raise ValueError(f"status {status}: {body[:200]!r}")
            problem, told = f"status {status}", headers.get("Retry-After")
        except OSError as lost:
            problem = str(lost)
        if attempt < ATTEMPTS - 1:
            wait(min(float(told), LONGEST_WAIT) if told and told.replace(".", "", 1).isdigit() else pause)
            pause = min(2 * pause, LONGEST_WAIT)
    raise ConnectionError(f"gave up after {ATTEMPTS} attempts: {problem}")


@dataclass
class HttpProvider:
    """style "ollama" (one text a request) or "openai" (batches of 96, answers aligned by index)."""

    style: str
    url: str
    model: str
    transport: Transport
    key: str = ""
    gap: float = 0.0
    senders: int = 1
    dimension: int = DIMENSION
    wait: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _next: float = field(default=0.0, repr=False)

    def _post(self, body: dict) -> dict:
        if self.gap:  # least time between requests
            now = self.clock()
            if now < self._next:
                self.wait(self._next - now)
            self._next = max(now, self._next) + self.gap
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return json.loads(with_retry(lambda: self.transport(self.url, headers, json.dumps(body).encode()), self.wait))

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        if self.style == "ollama":
            out = [normalized(self._post({"model": self.model, "prompt": t})["embedding"]) for t in texts]
        else:
            for i in range(0, len(texts), BATCH):
                part = list(texts[i : i + BATCH])
                data = self._post({"model": self.model, "input": part, "dimensions": self.dimension})["data"]
                by = {d["index"]: d["embedding"] for d in data}
                if sorted(by) != list(range(len(part))):
                    raise ValueError("answers do not match the texts asked for")
                out += [normalized(by[j]) for j in range(len(part))]
        if any(len(v) != self.dimension for v in out):
            raise ValueError(f"vectors must have {self.dimension} components")
        return out

    def embed_column(self, rows: DataFrame, key: str, text_col: str) -> DataFrame:
        """The key and an embedding of each row.

        With a gap there are at most `senders` tasks at work, each with a clock of its own and its share of the rate, so
        that all of them together keep the gap on average.
        """
        kind = rows.schema[key].dataType.simpleString()
        paced = replace(self, gap=self.gap * self.senders)
        if self.gap:
            rows = rows.repartition(self.senders)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({key: batch[key], "embedding": [v.tolist() for v in paced.embed_batch(batch[text_col].fillna("").tolist())]})

        return rows.select(key, text_col).mapInPandas(run, f"{key} {kind}, embedding array<float>")
