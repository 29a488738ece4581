"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A budget of tokens goes down the tree
by the weights of its nodes.  A node that cannot take its share, even with all
epochs allowed, takes what it can; the shortage goes to its siblings by their
weights, and only what none of them can take goes back to the parent and on to
the parent's siblings.

A leaf with budget b and t tokens gets b // t whole epochs and, from the next
one, the documents in seeded order whose running number of tokens is at most
the rest.  The running numbers are found in two steps: sums of hashed buckets,
then the order within the one bucket where the budget ends.

The leaves' totals are gathered on the driver; `most_leaves` bounds them.

Defined results: a null domain, language or source is a value of its own; a
null or empty text has 0 tokens and comes with its epoch, and a leaf without any
tokens comes once, as epoch 0, if its weights are positive; repeated rows are
documents of their own; weights not stated are 1, negative ones are errors; an
empty table gives an empty result.  All columns of the input are kept, and one
of the name of the epoch column is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a hashed bucket of a leaf, on average; and the fewest buckets.
BUCKET_ROWS, LEAST, HASHES = 4096, 4096, 1 << 40
Path = tuple[str | None, ...]


def share_out(amount: float, weights: list[float], most: list[float]) -> list[float]:
    """amount by weights, none above its most; what one cannot take goes to the others."""
    out = [0.0] * len(most)
    open_ = [i for i in range(len(most)) if weights[i] > 0 and most[i] > 0]
    while open_ and amount > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if most[i] <= amount * weights[i] / total]
        if not full:
            for i in open_:
                out[i] = amount * weights[i] / total
            break
        for i in full:
            out[i] = most[i]
        amount -= sum(most[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(supply: Mapping[Path, int], weights: Mapping[Path, float], amount: float, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf; weights are of nodes, named by their paths."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")

    def most(leaves: list[Path]) -> float:
        return float(sum(supply[leaf] for leaf in leaves) * epochs)

    def able(path: Path, leaves: list[Path]) -> float:
        """What the node can take: nothing below a weight of 0."""
        if weights.get(path, 1.0) == 0 and path:
            return 0.0
        if leaves == [path]:
            return most(leaves)
        return sum(able(p, below) for p, below in children(path, leaves).items())

    def children(path: Path, leaves: list[Path]) -> dict[Path, list[Path]]:
        out: dict[Path, list[Path]] = {}
        for leaf in leaves:
            out.setdefault(leaf[: len(path) + 1], []).append(leaf)
        return out

    def down(path: Path, leaves: list[Path], given: float) -> dict[Path, int]:
        if leaves == [path]:
            return {path: int(given + 1e-6)}
        below = children(path, leaves)
        shares = share_out(given, [weights.get(p, 1.0) for p in below], [able(p, x) for p, x in below.items()])
        out: dict[Path, int] = {}
        for (p, x), share in zip(below.items(), shares, strict=True):
            out |= down(p, x, share)
        return out

    leaves = sorted(supply, key=lambda p: tuple((v is not None, v or "") for v in p))
    return down((), leaves, min(amount, able((), leaves))) if leaves else {}


def mix(docs: DataFrame, domain: Column, weights: Mapping[Path, float], share: float = 0.8, epochs: int = 1, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", epoch_col: str = "epoch", most_leaves: int = 200_000) -> DataFrame:
    """The chosen documents with all their columns, once for each epoch they are in; budget: share of all tokens."""
    names = ["_domain", "_lang", "_source"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != epoch_col]).alias("_row"), domain.cast("string").alias("_domain"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"), F.xxhash64(F.col(id_col).cast("string"), text).alias("_hash"),
    )
    totals = rows.groupBy(*names).agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).limit(most_leaves + 1).collect()
    if len(totals) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves")
    buckets = 1 << max(LEAST, max((r.n for r in totals), default=0) // BUCKET_ROWS).bit_length()
    supply = {(r._domain, r._lang, r._source): int(r.t or 0) for r in totals}
    plan = budgets(supply, weights, share * sum(supply.values()), epochs)
    spark = docs.sparkSession
    wanted = lambda leaf: all(weights.get(leaf[:n], 1.0) > 0 for n in range(1, len(leaf) + 1))
    whole = {leaf: divmod(b, supply[leaf]) if supply[leaf] else (int(wanted(leaf)), 0) for leaf, b in plan.items()}
    table = spark.createDataFrame([(*leaf, int(e), int(rest)) for leaf, (e, rest) in whole.items()], "d string, l string, s string, full int, rest long")

    def with_plan(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        on = left["_domain"].eqNullSafe(right["d"]) & left["_lang"].eqNullSafe(right["l"]) & left["_source"].eqNullSafe(right["s"])
        return left.join(F.broadcast(right), on).drop("d", "l", "s")

    ranked = with_plan(rows, table).withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), "full", "_hash"), F.lit(HASHES)))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_h") / (HASHES // buckets)).cast("int"))
    sums = ranked.groupBy(*names, "rest", "_bucket").agg(F.sum("_tokens").alias("t"))
    running = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*names).orderBy("_bucket")))
    cuts = running.filter(F.col("upto") > F.col("rest")).groupBy(*names).agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("cut"))
    cuts = cuts.select(F.col("_domain").alias("d"), F.col("_lang").alias("l"), F.col("_source").alias("s"), F.col("cut._bucket").alias("cut"), F.col("cut.before").alias("before"))
    near = with_plan(ranked.filter("rest > 0"), cuts)
    inside = near.filter(F.col("_bucket") < F.col("cut")).select("_row", F.col("full").alias("_epoch"))
    order = Window.partitionBy(*names).orderBy("_h", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = near.filter(F.col("_bucket") == F.col("cut")).withColumn("upto", F.col("before") + F.sum("_tokens").over(order))
    last = edge.filter(F.col("upto") <= F.col("rest")).select("_row", F.col("full").alias("_epoch"))
    before = ranked.filter("full > 0").select("_row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("_epoch"))
    chosen = before.unionByName(inside).unionByName(last)
    return chosen.select("_row.*", F.col("_epoch").alias(epoch_col))
