import json

import numpy as np
import pytest

from quillon.functions import providers
from quillon.operators import search as S
from quillon.sources import sinks


def test_related_lists_and_json(spark, tmp_path):
    docs = spark.createDataFrame([(1, "/a", "A"), (2, "/b", "B"), (3, "/c", "C")], "id long, path string, title string")
    related = spark.createDataFrame([(1, 2, 3, 0.5), (1, 1, 2, 0.99999)], "a long, rank int, b long, score double")
    rows = sinks.related_lists(related, docs)
    sinks.write_json(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.path, [(e.path, e.score) for e in r.related]) for r in back] == [("/a", [("/b", 1.0), ("/c", 0.5)])]
    sinks.backup({"docs": docs}, str(tmp_path / "save"))
    assert spark.read.parquet(str(tmp_path / "save" / "docs")).count() == 3


def test_report(spark):
    means = spark.createDataFrame([(1, 0.5, 0.25, 0.3, 0.5, 1.0)], "k int, p double, r double, f1 double, ndcg double, hr double")
    single = spark.createDataFrame([("q", 1.0, 0.5, 0.5)], "qid string, mrr double, ap double, rprec double")
    failures = spark.createDataFrame([("q", "P@1", 0.5, 0.9)], "qid string, name string, value double, least double")
    text = sinks.report(means, single, failures)
    assert "0.500" in text and "MAP 0.5000" in text and "failed: q P@1" in text
    assert sinks.report(means, single, failures, "md").startswith("| k | P |")


def test_snippets_mark_the_best_window(spark):
    content = " ".join(["w"] * 30 + ["Alpha", "x", "beta"] + ["w"] * 30)
    docs = spark.createDataFrame([(1, content), (2, "beta")], "id long, content string")
    found = spark.createDataFrame([(1, 1), (1, 2)], "qid int, doc_id long")
    asked = S.prepare_queries(spark.createDataFrame([(1, "alp beta")], "qid int, query string"))
    got = {r.doc_id: r.snippet for r in S.snippets(found, docs, asked).collect()}
    assert "\x01Alpha\x02 x \x01beta\x02" in got[1] and got[1].startswith("…") and got[1].endswith("…")
    assert got[2] == "\x01beta\x02"


def test_http_providers():
    waits, calls = [], []

    def transport(url, headers, body):
        calls.append(json.loads(body))
        if len(calls) == 1:
            return 429, {"Retry-After": "7"}, b""
        if len(calls) == 2:
            raise OSError("lost")
        asked = calls[-1]["input"]
        return 200, {}, json.dumps({"data": [{"index": i, "embedding": [i + 1.0, 0.0]} for i in reversed(range(len(asked)))]}).encode()

    p = providers.HttpProvider("openai", "http://x", "m", transport, dimension=2, wait=waits.append)
    out = p.embed_batch(["a"] * 100)
    assert len(out) == 100 and np.allclose(out[5], [1, 0]) and [len(c["input"]) for c in calls] == [96, 96, 96, 4]
    assert waits == [7.0, 4.0]
    bad = providers.HttpProvider("ollama", "http://x", "m", lambda *a: (400, {}, b"no"), wait=waits.append)
    with pytest.raises(ValueError):
        bad.embed_batch(["a"])
    with pytest.raises(ConnectionError):
        providers.with_retry(lambda: (503, {}, b""), lambda s: None)
