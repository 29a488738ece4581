"""The written index, phrase search, full results, related documents as a whole, evaluation runs and sources, by brute force on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillon import session
from quillon.functions.embed import mock
from quillon.functions.markdown import chunk, default_single_chunk, front_matter_walk
from quillon.operators import evaluation as E
from quillon.operators import index as I
from quillon.operators import related as R
from quillon.operators import search as S
from quillon.operators import stats as M
from quillon.sources import files, sinks
from quillon.sources.pages import ItemPages

NOW = "2024-01-31"
TEXTS = {1: "The quick brown fox jumps over the lazy dog", 2: "quick fox brown dog", 3: "a brown fox, a brown fox and the lazy dog", 4: "", 5: None, 6: "Corazón de león and the LAZY dog"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"/s{i % 2}/d{i}.md", f"Title {i}", t, "en", f"s{i % 2}", "markdown") for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "id long, path string, title string, content string, lang string, source string, doc_type string").withColumn("last_modified", F.lit(NOW).cast("timestamp"))


def test_a_written_index_is_the_one_built(spark, docs, tmp_path):
    for folded in (True, False):
        path = f"{tmp_path}/index{folded}"
        I.write(docs, path, folded)
        built, read = I.build(docs, folded), I.read(spark, path, folded)
        rows = lambda df: sorted(tuple(r) for r in df.select("term", "doc_id", "title_tf", "content_tf").collect())
        assert rows(built.postings) == rows(read.postings)
        assert {r.doc_id: r.length for r in read.lengths.collect()} == {r.doc_id: r.length for r in built.lengths.collect()}
        assert {r.term: r.n_docs for r in read.vocabulary.collect()} == {r.term: r.n for r in built.postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
    places = {r.doc_id: r.positions for r in I.read(spark, f"{tmp_path}/indexTrue").postings.filter("term = 'brown'").collect()}
    assert places == {1: [2], 2: [2], 3: [1, 4]}
    where = F.array(F.array(F.lit(1), F.lit(7)), F.array(F.lit(3), F.lit(8)))
    assert spark.range(1).select(I.is_consecutive(where)).first()[0]
    assert not spark.range(1).select(I.is_consecutive(F.array(F.array(F.lit(1)), F.array(F.lit(3))))).first()[0]


def test_phrases(spark, docs, tmp_path):
    phrases = {1: "brown fox", 2: "the lazy dog", 3: "lazy", 4: "fox brown dog", 5: "dog fox", 6: '"Quick Brown Fox"', 7: "corazón de león"}
    asked = S.prepare_queries(spark.createDataFrame(list(phrases.items()), "qid int, query string"))
    I.write(docs, f"{tmp_path}/index")
    want = {(1, 1), (1, 3), (2, 1), (2, 3), (2, 6), (4, 2), (6, 1), (7, 6)}
    for index in (None, I.read(spark, f"{tmp_path}/index")):
        assert {tuple(r) for r in S.phrase_arm(docs, asked, 10, index).collect()} == want
    assert {tuple(r) for r in S.phrase_arm(docs.filter("id <> 1"), asked, 10, I.read(spark, f"{tmp_path}/index")).collect()} == {p for p in want if p[1] != 1}
    assert {tuple(r) for r in S.phrase_arm(docs, asked, 1).collect()} == {(1, 1), (2, 1), (4, 2), (6, 1), (7, 6)}


def test_full_results(spark, docs):
    chunks = spark.createDataFrame([(10 * i + k, i, f"chunk {k} of {i}", mock(f"{t} {k}").tolist()) for i, t in TEXTS.items() for k in range(2)], "chunk_id long, doc_id long, text string, embedding array<double>")
    engine = S.HybridSearch(docs, I.build(docs), chunks)
    asked = spark.createDataFrame([(1, "lazy dog"), (2, " ")], "qid int, query string")
    vectors = spark.createDataFrame([(q, mock("lazy dog").tolist()) for q in (1, 2)], "qid int, embedding array<double>")
    now = F.lit(NOW).cast("timestamp")
    rows = engine.search_full(asked, vectors, now, highlight=True).collect()
    assert {r.qid for r in rows} == {1} and len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert "\x01lazy\x02" in by[1].snippet and "<mark>lazy</mark>" in by[1].html and by[1].highlights == ["lazy", "dog"]
    assert by[4].snippet.startswith("chunk") and by[4].context.count("---") == 1 and by[4].token_estimate == (len(by[4].snippet) + 3) // 4
    assert engine.search_full(asked, vectors, now, where=S.scope("", [])).count() == 0
    only = engine.search_many(asked, vectors, now, where=S.scope("", ["s1"])).collect()
    assert {r.doc_id % 2 for r in only} == {1}
    assert S.scope("s9", ["s1"]).sources == ("s9",) and S.scope().sources == ()


def test_snippets_fit_in_bytes(spark):
    text = "é" * 400
    rows = spark.createDataFrame([(text, ""), ("x" * 301, ""), ("x" * 300, "")], "snippet string, context string")
    got = [r.snippet for r in S.enrich(rows).collect()]
    assert got == ["é" * 150 + "…", "x" * 300 + "…", "x" * 300]


def test_long_queries_are_errors(spark):
    fine = spark.createDataFrame([(1, "x" * 2000)], "qid int, query string")
    assert S.guard(fine).count() == 1
    with pytest.raises(Exception, match="query too long"):
        S.guard(spark.createDataFrame([(1, "é" * 1001)], "qid int, query string")).collect()


def test_ragged_vectors_are_left_out(spark):
    rows = [(1, 1, [3.0, 4.0]), (2, 1, [1.0, 2.0, 3.0]), (3, 1, [3.0, 4.0]), (4, 2, []), (5, 2, [0.0, 2.0])]
    got = {r.doc_id: r.vec for r in R.mean_vectors(spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<double>")).collect()}
    assert got == {1: pytest.approx([0.6, 0.8]), 2: pytest.approx([0.0, 1.0])}


@pytest.mark.parametrize("mocked", [True, False])
def test_related_as_a_whole(spark, mocked):
    """Without usable vectors only pairs of shared terms, tags or links are scored; reasons name the first shared tag."""
    n = 9
    docs = spark.createDataFrame([(i,) for i in range(n)], "id long")
    terms = spark.createDataFrame([(i, f"term{i % 4}") for i in range(n)] + [(8, "alone")], "doc_id long, term string")
    tags = spark.createDataFrame([(1, "b"), (2, "b"), (1, "a"), (2, "a"), (5, "b")], "doc_id long, tag string")
    edges = spark.createDataFrame([(3, 6)], "src long, dst long")
    vectors = spark.createDataFrame([(i, i, [1.0, 0.0] if mocked else [1.0, float(i)]) for i in range(n)], "chunk_id long, doc_id long, embedding array<double>")
    titles = spark.createDataFrame([(i, [f"t{i}"]) for i in range(n)], "doc_id long, terms array<string>")
    got = {(r.a, r.b): r for r in R.compute_all(docs, terms, tags, edges, vectors, titles).collect()}
    pairs = {(i, j) for i in range(n) for j in range(n) if i != j and (i % 4 == j % 4 or {i, j} <= {1, 2, 5} or {i, j} == {3, 6})}
    assert set(got) == (pairs if mocked else {(i, j) for i in range(n) for j in range(n) if i != j})
    assert got[3, 6].reasons[0] == "linked" and got[6, 3].reasons[0] == "back-linked" and "tag:a" in got[1, 2].reasons and "tag:b" in got[1, 5].reasons
    signals = {"lex": R.jaccard(terms, "term"), "link": R.link_scores(edges), "cat": R.overlap(tags, "tag")}
    assert {tuple(r) for r in R.candidates(signals).collect()} == pairs


def test_rarest_tags(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "z"), (2, "z"), (1, "y"), (2, "y"), (4, "q")], "doc_id long, tag string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert sorted(map(tuple, R.shared_tags(pairs, tags).collect())) == [(1, 2, "a"), (1, 3, "a")]
    assert sorted(map(tuple, R.shared_tags(pairs, tags, rarest=True).collect())) == [(1, 2, "y"), (1, 3, "a")]


def test_evaluation_runs(spark, tmp_path):
    found = {"one": ["a", "b", "x"], "two": ["x", "y"], "uno": ["a"]}
    table = spark.createDataFrame([(q, i + 1, item) for q, items in found.items() for i, item in enumerate(items)], "query string, rank int, item string")
    search = lambda queries, limit: queries.join(table, "query")
    rows = [("one", "en", "cat", ["a", "b"], ["x"], ["uno"], {"P@1": 1.0}), ("two", "en", "", ["a"], [], None, {"MRR": 0.5})]
    qrels = spark.createDataFrame(rows, "query string, lang string, category string, relevant array<string>, negative array<string>, variants array<string>, min_metrics map<string,double>")
    report = E.run_all(search, qrels, cutoffs=(1, 2))
    by = {(r.category, r.k): r for r in report.categories.collect()}
    assert set(by) == {("cat", 1), ("cat", 2), ("uncategorized", 1), ("uncategorized", 2)}
    assert (by["cat", 2].n, by["cat", 2].passed, by["cat", 2].failed) == (2, 1, 1) and by["uncategorized", 1].failed == 1
    assert by["cat", 2].p == pytest.approx((1 + 0.5) / 2) and by["uncategorized", 2].mrr == 0
    assert sorted(r.reason for r in report.failures.collect()) == ["MRR 0.000 < 0.500", "negative found: x"]
    sinks.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "categories")).count() == 4
    assert "uncategorized" in sinks.category_lines(report.categories)


def test_chunks_of_an_oversized_paragraph_are_its_own():
    assert chunk("aaaa bbbb cccc dddd eeee ffff gg\n\nhello", 24) == ["aaaa bbbb cccc dddd eeee", "ffff gg", "hello"]
    assert chunk("word " * 4 + "\n \n" + "more", 12) == ["word word", "word word", "more"] or chunk("x" * 30, 12) == ["x" * 12, "x" * 12, "x" * 6]
    assert all(len(p.encode()) <= 10 for p in chunk("é" * 40, 10)) and "".join(chunk("é" * 40, 10)) == "é" * 40


def test_documents_without_chunks(spark):
    docs = spark.createDataFrame([(1, "one", [1.0]), (2, "two", [2.0])], "id long, content string, embedding array<double>")
    chunks = spark.createDataFrame([(1, 0, "part", [3.0])], "doc_id long, chunk_index int, text string, embedding array<double>")
    assert sorted(map(tuple, default_single_chunk(docs, chunks).select("doc_id", "chunk_index", "text").collect())) == [(1, 0, "part"), (2, 0, "two")]
    with pytest.raises(Exception, match="no chunks and no embedding"):
        default_single_chunk(docs.withColumn("embedding", F.lit(None).cast("array<double>")), chunks).collect()


def test_front_matter_and_links(spark):
    pages = [("a.md", "---\nslug: first\ntags: [x, y]\n---\n[b](/b/) [out](https://e.org/b) [self](/first/)"), ("sub/b.md", "no fields [a](../first#part) [none](/nowhere/)"), ("c.md", "---\nbroken: [\n---\ntext"), ("d.md", "of no document")]
    docs = spark.createDataFrame([(1, "a.md"), (2, "content/sub/b.md"), (3, "old/c.md"), (4, "older/c.md")], "id long, path string")
    meta, links = front_matter_walk(spark.createDataFrame(pages, "path string, content string"), docs, ["tags"], "content/")
    assert sorted((r.doc_id, r.slug, list(r.taxonomy)) for r in meta.collect()) == [(1, "first", ["x", "y"]), (2, "b", []), (3, "c", [])]
    assert sorted(map(tuple, links.collect())) == [(1, 2), (2, 1)]


def test_paged_items(spark, tmp_path):
    every = [{"number": i, "title": f"t{i}", "body": None, "state": "open" if i % 2 else "closed", "updated_at": "2024-01-01", "comments": ["c"]} | ({"pull_request": {}} if i % 5 == 0 else {}) for i in range(1, 24)]
    for page in range(3):
        (tmp_path / f"p{page + 1}.json").write_text(json.dumps(every[10 * page : 10 * page + 10]))
    spark.dataSource.register(ItemPages)
    feed = spark.read.format("item_pages").option("url", f"file://{tmp_path}/p{{page}}.json").option("page_size", "10").option("lanes", "2").load()
    assert sorted(r.number for r in feed.collect()) == list(range(1, 24))
    issues = files.open_items(feed, "issue")
    assert sorted(r.number for r in issues.collect()) == [i for i in range(1, 24) if i % 2 and i % 5]
    assert files.one_item(feed, 4).first().title == "t4"
    known = spark.createDataFrame([(f"gh:o/r/issues/{i}",) for i in (1, 2, 99)] + [("gh:o/other/issues/2",)], "path string")
    assert sorted(r.path for r in files.closed_items(known, feed, "o/r", "issue").collect()) == ["gh:o/r/issues/2", "gh:o/r/issues/99"]


def test_repeated_keys_give_one_document(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id long, path string, title string").withColumn("last_modified", F.lit(NOW).cast("timestamp"))
    new = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "path string, title string")
    got = M.upsert(old, new, F.lit(NOW).cast("timestamp")).collect()
    assert sorted((r.path, r.title) for r in got) == [("a", "q"), ("b", "r")]


def test_counts_of_stored_things(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    row = M.stored_bytes(spark, str(tmp_path / "t")).first()
    assert row.files >= 1 and row.bytes == sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 1)], "src long, dst long")
    assert {r.doc_id: (r.n_out, r.n_in) for r in M.link_count(links).collect()} == {1: (1, 2), 2: (1, 1), 3: (1, 0)}


def test_no_local_folder_off_one_machine(spark):
    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Far())
