"""Retrieval metrics of rankings against judgments, in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def expand_variants(qrels: DataFrame) -> DataFrame:
    """Every variant of a query as a query of its own."""
    return qrels.select(F.explode(F.concat(F.array("query"), F.coalesce("variants", F.array().cast("array<string>")))).alias("query"), *[c for c in qrels.columns if c not in ("query", "variants")])


def judged(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, rank, item, rel, cum: whether each ranked item is relevant and how many are so far."""
    hit = ranking.join(relevant.select("qid", "item").distinct().withColumn("hit", F.lit(1)), ["qid", "item"], "left")
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hit.withColumn("rel", F.coalesce("hit", F.lit(0))).withColumn("cum", F.sum("rel").over(so_far)).select("qid", "rank", "item", "rel", "cum")


def _cutoffs(cutoffs: Sequence[int]):
    return F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")


def at_k(rows: DataFrame, relevant: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """qid, k, p, r, f1, hr, ndcg with binary gains; precision divides by k even for short rankings."""
    total = relevant.select("qid", "item").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    queries = rows.select("qid").distinct().unionByName(total.select("qid")).distinct().select("qid", _cutoffs(cutoffs))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    found = queries.join(rows, "qid", "left").groupBy("qid", "k").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), gain)), F.lit(0.0)).alias("dcg"),
    )
    found = found.join(total, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_rel", "k").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p = F.col("hits") / F.col("k")
    r = F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(F.lit(0.0))
    out = found.select("qid", "k", p.alias("p"), r.alias("r"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hr"), F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"))
    return out.withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0)))


def per_query(rows: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, mrr, ap (over the relevant items retrieved), ap_standard (over all relevant), rprec."""
    total = relevant.select("qid", "item").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    out = rows.join(total, "qid", "left").groupBy("qid").agg(
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.avg(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank"))).alias("ap"),
        F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank"))).alias("ap_sum"), F.max("n_rel").alias("n_rel"),
        F.sum(F.when(F.col("rank") <= F.col("n_rel"), F.col("rel"))).alias("r_hits"),
    )
    part = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select("qid", part(1 / F.col("first")).alias("mrr"), part(F.col("ap")).alias("ap"), part(F.col("ap_sum") / F.col("n_rel")).alias("ap_standard"), part(F.col("r_hits") / F.col("n_rel")).alias("rprec"))


def graded_ndcg(ranking: DataFrame, grades: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """qid, k, ndcg with linear gains; grades: qid, item, grade."""
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "item"))
    ideal = grades.filter("grade > 0").withColumn("rank", ideal_rank)
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    dcg = ranking.join(grades, ["qid", "item"]).select("qid", "rank", gain.alias("g"), F.lit(0.0).alias("ig"))
    idcg = ideal.select("qid", "rank", F.lit(0.0).alias("g"), gain.alias("ig"))
    both = dcg.unionByName(idcg).select("*", _cutoffs(cutoffs)).filter(F.col("rank") <= F.col("k"))
    return both.groupBy("qid", "k").agg(F.sum("g").alias("g"), F.sum("ig").alias("ig")).select("qid", "k", F.when(F.col("ig") > 0, F.col("g") / F.col("ig")).otherwise(F.lit(0.0)).alias("ndcg"))


def means(metrics: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("qid", *keys)]
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def negatives_found(ranking: DataFrame, negatives: DataFrame) -> DataFrame:
    """qid, item of ranked items that must not be found."""
    return ranking.join(negatives, ["qid", "item"], "left_semi").select("qid", "item")


def threshold_failures(metrics: DataFrame, single: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, name, value, least where a metric is below its least; names as P@5, R@3, F1@k, NDCG@k, HR@k, MRR, AP, RPrec."""
    names = {"p": "P", "r": "R", "f1": "F1", "ndcg": "NDCG", "hr": "HR"}
    long = metrics.select("qid", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}@"), F.col("k").cast("string")).alias("name"), F.col(c).cast("double").alias("value")) for c, n in names.items()])).alias("m"))
    alone = single.select("qid", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in (("mrr", "MRR"), ("ap", "AP"), ("rprec", "RPrec"))])).alias("m"))
    every = long.unionByName(alone).select("qid", "m.name", "m.value")
    return every.join(wanted, ["qid", "name"]).filter(F.col("value") < F.col("least")).select("qid", "name", "value", "least")


def rank_histogram(first_ranks: DataFrame) -> DataFrame:
    """bucket, n of first relevant ranks; null is a miss."""
    r = F.col("rank")
    bucket = F.when(r.isNull(), "miss").when(r == 1, "1").when(r == 2, "2").when(r == 3, "3").when(r <= 5, "4-5").when(r <= 10, "6-10").otherwise("miss")
    return first_ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def categories(at: DataFrame, single: DataFrame, failures: DataFrame, category: DataFrame) -> DataFrame:
    """category, k, n, passed, failed and mean p, r, f1, hr, ndcg, mrr, ap, rprec; queries without a category are "uncategorized".

    failures: qid of failed thresholds and negatives found; category: qid, category.
    """
    named = category.select("qid", F.when(F.coalesce("category", F.lit("")) == "", "uncategorized").otherwise(F.col("category")).alias("category"))
    bad = failures.select("qid").distinct().withColumn("bad", F.lit(1))
    rows = at.join(single.select("qid", "mrr", "ap", "rprec"), "qid", "left").join(named, "qid", "left").join(bad, "qid", "left").fillna({"category": "uncategorized", "bad": 0})
    means_ = [F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("p", "r", "f1", "hr", "ndcg", "mrr", "ap", "rprec")]
    return rows.groupBy("category", "k").agg(F.count("*").alias("n"), F.sum(1 - F.col("bad")).alias("passed"), F.sum("bad").alias("failed"), *means_)


@dataclass
class Report:
    """Metrics by query and cutoff, metrics by query, failures (qid, reason), means by cutoff and by category."""

    at: DataFrame
    single: DataFrame
    failures: DataFrame
    means: DataFrame
    categories: DataFrame


def run_all(search: Callable[[DataFrame, int], DataFrame], qrels: DataFrame, cutoffs: Sequence[int] = CUTOFFS, limit: int = 10) -> Report:
    """Search all judged queries in one batch and report on them.

    search: of queries (qid, query, lang) and a limit, gives qid, rank, item.  qrels: query, lang, category, relevant and,
    where there are any, negative, variants, min_metrics (name -> least value).  Every variant is a query of its own.
    """
    columns = set(qrels.columns)
    every = expand_variants(qrels) if "variants" in columns else qrels
    every = every.withColumn("qid", F.xxhash64("query", *(c for c in ("lang", "category") if c in columns)))
    lang = F.col("lang") if "lang" in columns else F.lit("")
    ranking = search(every.select("qid", "query", lang.alias("lang")), limit).filter(F.col("rank") <= limit).select("qid", "rank", "item")
    relevant = every.select("qid", F.explode("relevant").alias("item"))
    rows = judged(ranking, relevant)
    everyone = every.select("qid").distinct()
    at = at_k(rows, relevant, cutoffs)
    single = everyone.join(per_query(rows, relevant), "qid", "left").fillna(0.0)
    failures = everyone.limit(0).select("qid", F.lit("").alias("reason"))
    if "min_metrics" in columns:
        wanted = every.select("qid", F.explode("min_metrics").alias("name", "least"))
        failed = threshold_failures(at, single, wanted)
        failures = failures.unionByName(failed.select("qid", F.format_string("%s %.3f < %.3f", "name", "value", "least").alias("reason")))
    if "negative" in columns:
        found = negatives_found(ranking, every.select("qid", F.explode("negative").alias("item")))
        failures = failures.unionByName(found.select("qid", F.concat(F.lit("negative found: "), F.col("item").cast("string")).alias("reason")))
    category = every.select("qid", (F.col("category") if "category" in columns else F.lit("")).alias("category"))
    return Report(at, single, failures, means(at, "k"), categories(at, single, failures, category))
