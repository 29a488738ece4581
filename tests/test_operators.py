import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.operators import related as R
from quillon.operators import stats as M
from quillon.sources import files
from quillon.streaming import changes


def test_metrics_in_closed_form(spark):
    ranking = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate("abcd")], "qid string, rank int, item string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z"), ("other", "y")], "qid string, item string")
    rows = E.judged(ranking, relevant)
    at = {(r.qid, r.k): r for r in E.at_k(rows, relevant).collect()}
    assert at["q", 3].p == pytest.approx(2 / 3) and at["q", 10].p == 0.2 and at["q", 3].r == pytest.approx(2 / 3)
    assert at["q", 3].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.584962500721156 + 0.5))
    assert at["other", 10].p == 0 and at["other", 10].ndcg == 0
    one = E.per_query(rows, relevant).first()
    assert (one.mrr, one.ap, one.ap_standard, one.rprec) == (1.0, pytest.approx(5 / 6), pytest.approx(5 / 9), pytest.approx(2 / 3))
    assert [r.item for r in E.negatives_found(ranking, spark.createDataFrame([("q", "d"), ("q", "x")], "qid string, item string")).collect()] == ["d"]


def test_variants(spark):
    qrels = spark.createDataFrame([("a", ["b", "c"], 1), ("d", None, 2)], "query string, variants array<string>, n int")
    assert sorted(tuple(r) for r in E.expand_variants(qrels).collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]


def test_pair_signals(spark):
    items = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "z"), (2, "y"), (3, "w")], "doc_id long, term string")
    assert {(r.a, r.b): r.score for r in R.jaccard(items, "term").collect()} == {(1, 2): pytest.approx(1 / 3), (2, 1): pytest.approx(1 / 3)}
    edges = spark.createDataFrame([(1, 5), (6, 5), (1, 6)], "src long, dst long")
    got = {(r.a, r.b): round(r.score, 6) for r in R.link_scores(edges).collect()}
    assert got[1, 5] == 1 and got[5, 1] == 0.7 and got[1, 6] == 1 and got[6, 1] == 0.7 and got[5, 6] == 0.7


def test_diversify_prefers_what_differs(spark):
    pooled = spark.createDataFrame([(1, 2, 1, 1.0), (1, 3, 2, 0.9), (1, 4, 3, 0.8)], "a long, b long, rank int, score double")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "doc_id long, vec array<double>")
    terms = spark.createDataFrame([(2, "t")], "doc_id long, term string")
    rows = R.mmr(pooled, vectors, terms, R.Settings(limit=2)).orderBy("rank").collect()
    assert [r.b for r in rows] == [2, 4]
    assert [r.b for r in R.mmr(pooled, vectors, terms, R.Settings(limit=3)).orderBy("rank").collect()] == [2, 3, 4]


def test_maintenance(spark):
    docs = spark.createDataFrame([(1, "/a", "s"), (2, "/b", None)], "id long, path string, source string").withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    incoming = spark.createDataFrame([("/b", "new"), ("/c", "s")], "path string, source string")
    merged = {r.path: r for r in M.upsert(docs, incoming, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert merged["/b"].id == 2 and merged["/b"].source == "new" and merged["/c"].id not in (1, 2, None) and merged["/a"].last_modified.month == 1
    chunks = spark.createDataFrame([(1, 1), (2, 9)], "chunk_id long, doc_id long")
    kept, vectors = M.prune_orphans(docs, chunks, chunks.select("chunk_id"))
    assert [r.chunk_id for r in kept.collect()] == [1] and [r.chunk_id for r in vectors.collect()] == [1]
    facets = {(r.facet, r.value): r.n for r in M.facets(docs.withColumns({"doc_type": F.lit("m"), "lang": F.lit("en")})).collect()}
    assert facets["source", ""] == 1 and facets["lang", "en"] == 2


def test_files_added_changed_and_deleted(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub" / "B.MD").write_text("# B")
    (tmp_path / "c.txt").write_text("no")
    found = files.markdown_files(spark, str(tmp_path)).cache()
    assert found.count() == 2
    known = found.select("path", F.when(F.col("path").endswith("a.md"), F.col("hash")).otherwise("old").alias("hash")).unionByName(spark.createDataFrame([("file:/gone.md", "x")], "path string, hash string"))
    changed = files.changed(found, known, F.lit("2000-01-01").cast("timestamp"))
    assert [r.path.rsplit("/", 1)[1] for r in changed.collect()] == ["B.MD"]
    assert [r.path for r in files.deleted(known, found).collect()] == ["file:/gone.md"]


def test_change_stream(spark, tmp_path):
    rows = [(1, "p1", "opened", "open", 1), (2, "p1", "edited", "open", 3), (3, "p2", "opened", "open", 1), (4, "p2", "closed", "closed", 2), (5, "p3", "commented", "closed", 2)]
    schema = "event_id long, path string, action string, state string, updated_at long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    changes.apply_changes(stream, lambda up, down, n: seen.append(({r.path for r in up.collect()}, {r.path for r in down.collect()})), str(tmp_path / "check")).awaitTermination()
    assert seen == [({"p1"}, {"p2"})]
