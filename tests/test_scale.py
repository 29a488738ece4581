"""Steps whose rows must not grow with the square of the input, by the rows that the nodes of their plans put out."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import tokenize
from quillon.operators import index as I
from quillon.operators import related as R
from quillon.operators import search as S


def most_rows(df):
    """The rows of a query, and the most that a node of its plan puts out."""
    rows = df.collect()
    found = [0]

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max(found)


def brute_bm25(texts, queries):
    """(qid, doc_id) -> score by the definition."""
    lengths = {i: len(t) + len(c) for i, (t, c) in texts.items()}
    mean, n, out = sum(lengths.values()) / len(texts), len(texts), {}
    for q, terms in queries.items():
        tf = {p: {i: x for i, (t, c) in texts.items() if (x := 5.0 * sum(w.startswith(p) for w in t) + sum(w.startswith(p) for w in c))} for p in terms}
        for i in set.intersection(*(set(x) for x in tf.values())):
            idf = {p: max(math.log((n - len(x) + 0.5) / (len(x) + 0.5)), 1e-6) for p, x in tf.items()}
            out[q, i] = sum(idf[p] * tf[p][i] * 2.2 / (tf[p][i] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for p in terms)
    return out


def test_searches_by_titles_need_no_postings(spark):
    """Every document's title as a query; the plan makes no row for each query and document of a term."""
    n = 400
    texts = {i: (["common", f"w{i % 20}"], ["common", "words", f"w{i % 20}", f"x{i % 7}"] * (1 + i % 3)) for i in range(n)}
    docs = spark.createDataFrame([(i, " ".join(t), " ".join(c)) for i, (t, c) in texts.items()], "id long, title string, content string")
    built = I.build(docs.repartition(4))
    index = I.Index(None, None, None, built.folded, tokens=built.tokens)  # neither postings nor lengths are read
    asked = S.prepare_queries(docs.select(F.col("id").alias("qid"), F.col("title").alias("query")))
    rows, most = most_rows(S.fts_arm(index, asked, 10))
    want = brute_bm25(texts, {i: t for i, (t, _) in texts.items()})
    for q in range(n):
        ranked = sorted(((-round(s, 9), i) for (p, i), s in want.items() if p == q))[:10]
        assert [r.doc_id for r in sorted((r for r in rows if r.qid == q), key=lambda r: r.rank)] == [i for _, i in ranked]
    assert len(rows) == 10 * n and most <= 10 * n
    whole = {(r.qid, r.doc_id): r.score for r in S.bm25(index, asked).collect()}
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_title_groups_are_not_joined_whole(spark):
    """600 documents of one title, each its own query, are 20 rows a query and not 600."""
    docs = spark.range(600).select("id", F.lit("Same title").alias("title"), F.concat(F.lit("/s/"), F.when(F.col("id") % 2 == 0, "same-title").otherwise("other"), F.lit(".md")).alias("path"))
    asked = docs.select(F.col("id").alias("qid"), F.col("title").alias("phrase"), F.lit("same-title").alias("slug"))
    rows, most = most_rows(S.exact_arm(docs, asked, 10))
    assert {q: sorted(r.doc_id for r in rows if r.qid == q) for q in (0, 599)} == {0: list(range(20)), 599: list(range(20))}
    assert len(rows) == 12000 and most <= 2 * 20 * 600


def test_vectors_are_compared_in_blocks(spark):
    """The plan makes no row for each pair of a query and a chunk; ties go to the smaller id."""
    vectors = {i: [float(i % 50), float(i % 7), 0.5] for i in range(600)}
    chunks = spark.createDataFrame([(i, i // 3, v) for i, v in vectors.items()] + [(900, 300, [1.0]), (901, 300, None)], "chunk_id long, doc_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(q, vectors[q]) for q in range(0, 600, 5)], "qid int, embedding array<float>")
    rows, most = most_rows(S.vector_arm(chunks, asked, 2))
    for q in (0, 45, 595):
        want = sorted((round(math.dist(vectors[q], v), 9), i) for i, v in vectors.items())[:10]
        assert [(r.dist, r.chunk_id) for r in sorted((r for r in rows if r.qid == q), key=lambda r: r.rank)] == want
    assert len(rows) == 1200 and most <= 10 * 120 * 8
    few = S.vector_arm(chunks.filter("chunk_id >= 599"), asked.filter("qid = 0"), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.dist is None) for r in few] == [(599, False), (900, True), (901, True)]


def test_term_counts_by_batches(spark):
    """One row a term and batch is shuffled, none for each term of a document."""
    docs = spark.range(300).select("id", F.lit("Tïtle").alias("title"), F.concat(F.lit("a b á "), F.col("id") % 3).alias("content")).repartition(2)
    rows, _ = most_rows(I.term_counts(I.tokens_of(docs), True))
    assert {tuple(r) for r in rows} == {("title", 300, 300, 0), ("a", 300, 0, 600), ("b", 300, 0, 300), *((str(k), 100, 0, 100) for k in range(3))}


def test_salient_terms_by_blocks(spark):
    """terms are counted block by block; the same terms as by the definition."""
    texts = {i: {f"rare{i}", f"third{i % 3}", f"tenth{i % 10}", "everywhere", "xy"} for i in range(90)}
    tokens = spark.createDataFrame([(i, sorted(t) * 2) for i, t in texts.items()], "doc_id long, content_tokens array<string>")
    df = {t: sum(t in x for x in texts.values()) for t in set.union(*texts.values())}
    rows, most = most_rows(R.salient_of(tokens, 90, 2, block_docs=30))
    want = {(i, t, k + 1) for i, x in texts.items() for k, t in enumerate(sorted((t for t in x if len(t) > 2 and df[t] < 45), key=lambda t: (df[t], t))[:2])}
    assert {(r.doc_id, r.term, r["rank"]) for r in rows} == want
    assert all(r.value == pytest.approx(math.log(91 / (df[r.term] + 1))) for r in rows) and most < sum(map(len, texts.values()))


def test_pairs_of_hot_values_are_not_shuffled(spark):
    """300 documents of one value are 89,700 pairs; no node makes them but the one that puts them out, and none is shuffled."""
    items = spark.createDataFrame([(i, "hot") for i in range(300)] + [(i, f"v{i // 2}") for i in range(300)], "doc_id long, term string")
    tags = items.withColumnRenamed("term", "tag")
    values = {i: {"hot", f"v{i // 2}"} for i in range(300)}
    same = {(a, b): len(values[a] & values[b]) for a in values for b in values if a != b}
    def shuffled(df):
        rows, _ = most_rows(df)
        total = [0]

        def walk(node):
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                return walk(node.executedPlan())
            if kind.endswith("QueryStageExec"):
                return walk(node.plan())
            if kind == "ShuffleExchangeExec":
                total.append(node.metrics().get("shuffleRecordsWritten").get().value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(df._jdf.queryExecution().executedPlan())
        return rows, max(total)

    for df, want in (
        (R.jaccard(items, "term"), {p: n / (4 - n) for p, n in same.items()}),
        (R.overlap(items, "term"), {p: n / 2 for p, n in same.items()}),
        (R.idf_overlap(tags, 300), {p: (math.log1p(1) + (n - 1) * math.log1p(150)) / (math.log1p(1) + math.log1p(150)) for p, n in same.items()}),
    ):
        rows, most = shuffled(df)
        assert {(r.a, r.b) for r in rows} == want.keys() and all(r.score == pytest.approx(want[r.a, r.b]) for r in rows) and most < 2000
    for rarest in (False, True):
        rows, most = shuffled(R.all_shared_tags(tags, rarest))
        assert {(r.a, r.b): r.tag for r in rows} == {(a, b): f"v{a // 2}" if rarest and a // 2 == b // 2 else "hot" for a, b in same if a < b} and most < 2000
    edges = spark.createDataFrame([(i, 1000) for i in range(300)], "src long, dst long")
    rows, most = shuffled(R.link_scores(edges))
    got = {(r.a, r.b): r.score for r in rows}
    assert len(rows) == len(got) == 300 * 299 + 600 and got[5, 6] == 0.4 and got[5, 1000] == 1 and got[1000, 5] == 0.7 and most < 2000
    vectors = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(300)], "doc_id long, vec array<double>")
    rows, most = shuffled(R.semantic_scores(vectors))
    assert len(rows) == 300 * 299 and {(r.a, r.b): r.score for r in rows}[0, 4] == 1.0 and most < 2000


def test_pools_are_those_of_all_pairs(spark):
    """Scores, demotion by titles and the order of each pool by brute force."""
    import random

    draw, n = random.Random(1), 60
    terms = {i: {f"t{draw.randrange(25)}" for _ in range(3)} for i in range(n)}
    tags = {i: {f"g{draw.randrange(12)}"} for i in range(0, n, 3)}
    edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(30)}
    vec = {i: [draw.uniform(-1, 1), draw.uniform(-1, 1), draw.uniform(-1, 1)] for i in range(0, n, 2)}
    titles = {i: {f"w{draw.randrange(3)}" for _ in range(2)} for i in range(n) if i % 5}
    rows = lambda d: [(i, x) for i, xs in d.items() for x in sorted(xs)]
    out, into = ({i: {e[1 - k] for e in edges if e[k] == i} for i in range(n)} for k in (0, 1))
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    s = R.Settings(limit=2, pool_factor=3)
    want = {}
    for a in range(n):
        found = []
        for b in range(n):
            sem = max(sum(x * y for x, y in zip(vec[a], vec[b], strict=True)), 0) if a in vec and b in vec else 0.0
            cat = len(tags[a] & tags[b]) / min(len(tags[a]), len(tags[b])) if a in tags and b in tags else 0.0
            link = 1.0 if (a, b) in edges else 0.7 if (b, a) in edges else 0.4 * max(jac(out[a], out[b]), jac(into[a], into[b]))
            score = 0.55 * sem + 0.2 * jac(terms[a], terms[b]) + 0.15 * link + 0.1 * cat
            if jac(titles.get(a, set()), titles.get(b, set())) >= 0.5 and sem < 0.35 and link == 0 and cat == 0:
                score *= 0.35
            score = round(max(score, 0.5) if link >= 0.999 else score, 9)
            if a != b and score > 0:
                found.append((-score, b))
        want |= {(a, b): (k + 1, -x) for k, (x, b) in enumerate(sorted(found)[:6])}
    pooled = R.pool(
        spark.createDataFrame(rows(terms), "doc_id long, term string"), spark.createDataFrame(rows(tags), "doc_id long, tag string"), spark.createDataFrame(list(edges), "src long, dst long"),
        spark.createDataFrame(list(vec.items()), "doc_id long, vec array<double>"), spark.createDataFrame([(i, sorted(x)) for i, x in titles.items()], "doc_id long, terms array<string>"), s,
    )
    got = {(r.a, r.b): (r["rank"], pytest.approx(r.score, abs=2e-9)) for r in pooled.collect()}
    assert got == want


def test_reasons_name_the_shared_tag(spark, tmp_path):
    """related_reasons left the shared tag out."""
    from quillon.plans.queries import QUERIES

    spark.createDataFrame([(i, f"text number {i}", "en", "src1") for i in range(4)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * i, [1.0, float(i)], i % 2) for i in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(0, "<a href=\"/x\">x</a>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.a, r.b): r.reasons for r in QUERIES["related_reasons"](spark, str(tmp_path)).collect()}
    assert "tag:0" in got[0, 2].split(",") and "tag:1" in got[3, 1].split(",") and "tag:" not in got[0, 1]


def test_stemming_remembers_a_bounded_number_of_words(spark):
    """columns are stemmed in one pass without a join, in small slices, with a small memory."""
    from quillon.functions.stem import stem_columns, stem_en

    docs = spark.createDataFrame([(i, "en", f"Running {i}", f"shoes w{i}s cats") for i in range(50)] + [(99, "xx", None, "shoes")], "id long, lang string, title string, content string")
    got = {r.id: r for r in stem_columns(docs, {"stemmed_title": "title", "content": "content"}, most=3, at_once=4).collect()}
    assert got[7].content == " ".join(stem_en(w) for w in ("shoes", "w7s", "cats")) and got[7].stemmed_title == f"{stem_en('running')} 7" and got[7].title == "Running 7"
    assert got[99].content == "shoes" and got[99].stemmed_title == "" and len(got) == 51
