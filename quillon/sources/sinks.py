"""Outputs: related documents and rankings as JSON, evaluation reports, table backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.evaluation import Report


def related_lists(related: DataFrame, docs: DataFrame) -> DataFrame:
    """path, related: each source's list of (path, title, score) in order; a source without any has no row."""
    names = docs.select(F.col("id").alias("b"), F.col("path").alias("to_path"), "title")
    rows = related.join(names, "b").join(docs.select(F.col("id").alias("a"), "path"), "a")
    entries = F.array_sort(F.collect_list(F.struct("rank", F.col("to_path").alias("path"), "title", F.round("score", 4).alias("score"))))
    return rows.groupBy("path").agg(F.transform(entries, lambda e: F.struct(e["path"].alias("path"), e["title"].alias("title"), e["score"].alias("score"))).alias("related"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def report(means: DataFrame, single: DataFrame, failures: DataFrame, style: str = "text", most_shown: int = 1000) -> str:
    """Mean metrics by cutoff, mean MRR, AP and R-precision, and failed thresholds; style text or md.

    What is collected is one row per cutoff and at most `most_shown` failures; the number of others is stated.
    """
    columns = ["p", "r", "f1", "ndcg", "hr"]
    rows = means.orderBy("k").collect()
    alone = single.agg(*[F.avg(c).alias(c) for c in ("mrr", "ap", "rprec")]).first()
    head = ["k", *[c.upper() for c in columns]]
    body = [[str(r["k"]), *[f"{r[c]:.3f}" for c in columns]] for r in rows]
    if style == "md":
        lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(b) + " |" for b in body], ""]
    else:
        lines = ["".join(f"{h:>8}" for h in head), *["".join(f"{v:>8}" for v in b) for b in body]]
    lines.append("  ".join(f"{n} {alone[c] or 0:.4f}" for c, n in (("mrr", "MRR"), ("ap", "MAP"), ("rprec", "R-Prec"))))
    n = failures.count()
    shown = failures.orderBy("qid", "name").limit(most_shown).collect()
    lines += [f"failed: {f['qid']} {f['name']} {f['value']:.3f} < {f['least']:.3f}" for f in shown]
    lines += [f"failed: {n - len(shown)} more"] if n > len(shown) else []
    return "\n".join(lines) + "\n"


def category_lines(categories: DataFrame) -> str:
    """One line for each category and cutoff; what is collected is one row for each of them."""
    names = ["p", "r", "f1", "ndcg", "hr", "mrr", "ap", "rprec"]
    head = f"{'category':<20}{'k':>4}{'pass':>6}{'fail':>6}" + "".join(f"{n:>8}" for n in names)
    rows = categories.orderBy("category", "k").collect()
    return "\n".join([head, *(f"{r['category']:<20}{r['k']:>4}{r['passed']:>6}{r['failed']:>6}" + "".join(f"{r[n]:>8.3f}" for n in names) for r in rows)]) + "\n"


def write_report(report: Report, path: str) -> None:
    """The parts of a report as JSON below a folder, one object a row."""
    for name in ("at", "single", "failures", "means", "categories"):
        write_json(getattr(report, name), f"{path}/{name}")
