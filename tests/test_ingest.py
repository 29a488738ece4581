import json
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import encoder
from quillon.plans.ingest import Store, maintain, sync_folder
from quillon.sources import git


def test_incremental_sync_equals_a_full_one(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n\nRunning dogs.")
    (root / "b.md").write_text("---\ntitle: B\nlang: es\n---\nlos libros")
    store = Store(spark, str(tmp_path / "store"))
    now = F.lit("2030-01-01").cast("timestamp")
    assert sync_folder(store, str(root), "local", F.lit("2001-01-01").cast("timestamp")) == {"changed": 2, "deleted": 0}
    first = {r.title: r for r in store.read("documents").collect()}
    assert first["Alpha"].content == "alpha run dog" and first["B"].content == "libr"
    (root / "a.md").write_text("# Alpha\n\nWalking cats.")
    (root / "b.md").unlink()
    (root / "c.md").write_text("# Gamma")
    assert sync_folder(store, str(root), "local", now) == {"changed": 2, "deleted": 1}
    rows = {r.title: r for r in store.read("documents").collect()}
    assert set(rows) == {"Alpha", "Gamma"} and rows["Alpha"].id == first["Alpha"].id and rows["Alpha"].content == "alpha walk cat"
    assert {r.doc_id for r in store.read("chunks").collect()} == {r.id for r in rows.values()}
    fresh = Store(spark, str(tmp_path / "fresh"))
    sync_folder(fresh, str(root), "local", now, full=True)
    key = lambda s: sorted((r.path, r.hash, r.content) for r in s.read("documents").collect())
    assert key(store) == key(fresh)
    assert sync_folder(store, str(root), "local", now) == {"changed": 0, "deleted": 0}
    before = key(store)
    store.write("chunks", store.read("chunks").unionByName(store.read("chunks").withColumns({"doc_id": F.lit(-1).cast("long"), "chunk_id": F.col("chunk_id") + 1})))
    maintain(store)
    assert key(store) == before and {r.doc_id for r in store.read("chunks").collect()} == {r.id for r in rows.values()}
    assert all(len([p for p in (tmp_path / "store" / n).iterdir() if p.is_dir()]) == 1 for n in ("chunks", "documents"))


def test_git_source(tmp_path):
    origin, copy = tmp_path / "origin", tmp_path / "copy"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=origin, check=True, capture_output=True)
    run("init", "-q")
    (origin / "a.md").write_text("a")
    (origin / "b.txt").write_text("b")
    run("add", "-A")
    run("commit", "-qm", "one")
    assert git.sync(f"file://{origin}", str(copy)) == ["a.md"]
    (origin / "c.MD").write_text("c")
    run("add", "-A")
    run("commit", "-qm", "two")
    assert git.sync(f"file://{origin}", str(copy)) == ["c.MD"]
    assert git.with_token("https://u@host/x.git", "a b") == "https://a%20b@host/x.git" and git.with_token("git@host:x", "t") == "git@host:x"


def test_word_pieces():
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!", "中"]
    t = encoder.WordPiece(vocabulary, limit=6)
    assert t.encode("Unaffable!") == [2, 4, 5, 6, 8, 3]
    assert t.encode("CAFÉ 中 zzz") == [2, 7, 9, 1, 3]
    assert len(t.encode("cafe " * 50)) == 6 and t.pieces("a" * 101) == [1]


def test_encoder_is_deterministic_and_ignores_padding(tmp_path):
    rng = np.random.default_rng(0)
    width, inner, layers = 8, 16, 2
    w = {"embeddings.word_embeddings.weight": (10, width), "embeddings.position_embeddings.weight": (16, width), "embeddings.token_type_embeddings.weight": (2, width), "embeddings.LayerNorm.weight": (width,), "embeddings.LayerNorm.bias": (width,)}
    for i in range(layers):
        p = f"encoder.layer.{i}"
        for name, shape in (("attention.self.query", (width, width)), ("attention.self.key", (width, width)), ("attention.self.value", (width, width)), ("attention.output.dense", (width, width)), ("intermediate.dense", (inner, width)), ("output.dense", (width, inner))):
            w |= {f"{p}.{name}.weight": shape, f"{p}.{name}.bias": shape[:1]}
        for name in ("attention.output.LayerNorm", "output.LayerNorm"):
            w |= {f"{p}.{name}.weight": (width,), f"{p}.{name}.bias": (width,)}
    tensors = {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in w.items()}
    header, body = {}, b""
    for k, v in tensors.items():
        header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [len(body), len(body) + v.nbytes]}
        body += v.tobytes()
    raw = json.dumps(header).encode()
    (tmp_path / "model.safetensors").write_bytes(len(raw).to_bytes(8, "little") + raw + body)
    (tmp_path / "vocab.txt").write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "d", "e", "f"]))
    e = encoder.Encoder.load(str(tmp_path), heads=2, layers=layers)
    both = e.encode(["a b", "a b c d e f a b"])
    assert np.allclose(both[0], e.encode(["a b"])[0], atol=1e-5) and np.allclose(np.linalg.norm(both, axis=1), 1, atol=1e-5)
    assert e.encode([]).shape == (0, width)


def test_registered_providers_and_paced_senders(spark):
    import numpy as np

    from quillon.functions import embed
    from quillon.functions.providers import HttpProvider

    with pytest.raises(ValueError):
        embed.register_provider("short", lambda t: np.zeros(3))
    embed.register_provider("ones", lambda t: np.ones(embed.DIMENSION, np.float32))
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "k long, text string").repartition(3)
    assert {r.embedding[0] for r in embed.embed_all(rows, "ones", "k", "text").collect()} == {1.0}
    embed.PROVIDERS.pop("ones")

    def answer(url, headers, body):
        return 200, {}, b'{"embedding": [3.0, 4.0]}'

    http = HttpProvider("ollama", "http://x", "m", answer, gap=0.02, senders=2, dimension=2)
    assert http.embed_column(rows, "k", "text").rdd.getNumPartitions() == 2
    began = time.monotonic()
    assert [round(x, 6) for x in http.embed_column(rows, "k", "text").first().embedding] == [0.6, 0.8]
    assert time.monotonic() - began > 0
