"""Queries over the driver's tables, one for each operator, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, near_dup, ordinal, toxicity
from .line_rules import BOILERPLATE, CLOSING, line_first_clean
from .mixing import mix
from .ngram_lm import score_texts
from .packing import pack
from .samples import fold_of
from .session import documents, prepare
from .shards import assign
from .substrings import remove_repeats


def op4_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_first_clean(documents(spark, sf_dir), with_text=False)
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "n_kept_words", "lost")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return bit_sliced.search(vectors, F.col("vec_id") % 20 == 0)


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


#: Target weights of domains and, in each, of languages; sources of a language weigh the same.
DOMAINS = {"web": 0.4, "books": 0.2, "news": 0.2, "forum": 0.2}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
MIX_WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGUAGES.items()}


def domain_of(source: str = "source") -> Column:
    """The driver's tables have no domains; sources are dealt to four by their checksum."""
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.element_at(names, (F.crc32(F.col(source).cast("binary")) % len(DOMAINS) + 1).cast("int"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source", domain_of().alias("domain"))
    mixed = mix(docs, F.col("domain"), MIX_WEIGHTS, share=0.8, epochs=2)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Graded ratings: 0 poor, 1 fair (good but toxic), 2 good.
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    model = ordinal.train(docs, labels, grade, [0, 1, 2], fold_of("id", 5) != 0)
    graded = ordinal.grade_texts(docs, model, tail=1)
    return graded.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_prob", "grade", (F.col("tail_prob") >= 0.5).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_sliced_topk": op1_bit_sliced_topk,
    "op2_bag_minhash": op2_bag_minhash,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_vector_shards": op4_vector_shards,
    "op5_line_rules": op5_line_rules,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_ordinal_quality": op10_ordinal_quality,
}

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: All pairs of distinct texts by their shared shingles, then the classes that the links reach.
OP2_SQL = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id, any_value({WORDS.format("coalesce(text, '')")}) AS w FROM documents GROUP BY 1),
c AS (SELECT id, array_to_string(w[i:i + 4], ' ') AS g, count(*) AS n FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM t UNION SELECT b, root FROM r JOIN both_ways ON a = id)
SELECT doc_id, class_id FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN (SELECT id, min(root) AS class_id FROM r GROUP BY id) USING (id)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of LineRules() on every line, one after another.
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, {WORDS.format("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (
  SELECT doc_id, line, len(w) AS n, strlen(array_to_string(w, '')) AS bytes, w[-1][-1] AS last, translate(line, '{UPPER}', '{LOWER}') AS low,
    strlen(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS symbols, strlen(regexp_replace(line, '[^|]', '', 'g')) AS bars, strlen(regexp_replace(line, '[^!]', '', 'g')) AS marks,
    strlen(regexp_replace(line, '[^a-z]', '', 'g')) AS small, strlen(regexp_replace(line, '[^A-Z]', '', 'g')) AS capital,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stuttered
  FROM l WHERE len(w) > 0
),
f AS (
  SELECT doc_id, line, n, bytes,
    symbols > 0.3::DOUBLE * n OR marks > 0.5::DOUBLE * n AND capital > small OR n <= 3 AND NOT contains('{{closing}}', last)
    OR bars > 0.2::DOUBLE * n AND bars > 1 OR n >= 8 AND stuttered > 0.5::DOUBLE * n OR {{phrases}} AS failed
  FROM m
),
s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_removed_lines,
    coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS n_kept_words, coalesce(sum(bytes) FILTER (failed), 0) / sum(bytes) AS lost
  FROM f GROUP BY doc_id
),
b AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, strlen(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_kept_words, 0) AS n_kept_words, coalesce(lost, 0)::DOUBLE AS lost
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT base_failed AND lost <= 0.3::DOUBLE AND n_kept_words >= 10 AS kept FROM b
""".format(closing=CLOSING.replace("'", "''"), phrases=" OR ".join(f"contains(low, '{p.replace(chr(39), chr(39) * 2)}')" for p in BOILERPLATE))

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_bit_sliced_topk": OP1_SQL, "op2_bag_minhash": OP2_SQL, "op5_line_rules": OP5_SQL, "op8_substring_dedup": OP8_SQL}
