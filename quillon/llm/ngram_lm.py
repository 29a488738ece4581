"""Language-model scores from Elias-Fano n-gram tries over the counts of the whole corpus.

The model is a trigram model with hierarchical Dirichlet smoothing over an
add-one unigram model.  With counts c over the training texts, N tokens, V
distinct tokens and the prior strengths s2 and s3,

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = c(v w) / (c(v) + s2)     + s2 / (c(v) + s2)     * p(w)
    p(w | u v) = c(u v w) / (c(u v) + s3) + s3 / (c(u v) + s3) * p(w | v)

where a text's first token has no context and its second one word of it.

1. Documents are tokenised once, into written groups of about `GROUP_BYTES` of
   text: the distinct words of a group and its tokens by their numbers.
2. Shards of the words' 64-bit keys add up their counts and number them.
3. Every group states its distinct pairs and triples with its training counts
   to the shard of the first word, or, where that is a frequent one, of the
   pair.  A shard builds one trie from the sums, of all n-grams of its pairs: words, pairs and triples in levels of
   monotone pointers and of word numbers relative to their context, with the
   first terms of the formulas and the weights of the shorter context quantised
   to steps of 1/16 in log10, mapped from files.  The trie answers all n-grams
   that were asked, each distinct one once.
4. Groups put the answers together.

A key weighs as many times as there are groups that hold it, however frequent
it is: a third of all rows with one pair are one number from each group.  A
shard holds whole successor lists, none longer than the vocabulary.  Blocks
between groups and shards exist only where they hold something.  Words are
identified by 64-bit keys, pairs and triples by the numbers of their words.

Defined results: a null or empty text is the end token alone; rows with equal
ids are texts of their own; a null id counts as training (the checksum of no
text is taken as 0) and stays null.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W
from .elias_fano import Trie
from .exchange import pack_keys, planes, unpack_keys, unplanes
from .session import written

END = W.mix(np.array([0xE0D], W.U))[0]
#: Bytes of text in a group, tokens behind a shard of pairs, and behind one of words.
GROUP_BYTES, SHARD_TOKENS, WORD_TOKENS = 4_000_000, 1_000_000, 4_000_000
#: First words with more than this share of a shard's tokens have their pairs spread over all shards.
SPREAD = 1 / 16
GROUP_SCHEMA = "g long, ids array<long>, held array<boolean>, sizes array<long>, words binary, counts binary, tokens binary, n long"


@dataclass(frozen=True)
class Corpus:
    """Training tokens, distinct ones, and how many shards of words and of pairs there are."""

    tokens: int
    distinct: int
    word_shards: int
    shards: int


# 1. Groups.


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of the texts, each with an end token, and the number of each text's tokens."""
    words = W.words_of(W.texts_of(column), lower=True)
    return np.insert(words.hashes, words.first[1:], END), np.diff(words.first) + 1


def group_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of groups, in the order of the rows of a partition."""
    keys: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    parts: list[pa.RecordBatch] = []
    held = seq = 0
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def row() -> pa.RecordBatch:
        met, words = pd.factorize(np.concatenate(keys))
        order = np.argsort(words)
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        ids, flags = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "held_out"))
        each = np.concatenate(sizes)
        counts = np.bincount(rank[met], np.repeat(~flags.to_numpy(zero_copy_only=False), each), len(words)).astype(np.uint32)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        binary = [pa.array([x], pa.binary()) for x in (pack_keys(words[order]), planes(counts), planes(rank[met]))]
        return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), one(ids), one(flags), one(pa.array(each, pa.int64())), *binary, pa.array([len(met)], pa.int64())], ["g", "ids", "held", "sizes", "words", "counts", "tokens", "n"])

    for batch in batches:
        for part in W.pieces(batch):
            k, n = _tokens(part.column("text"))
            keys.append(k)
            sizes.append(n)
            parts.append(part)
            held += part.column("text").nbytes
            if held >= most:
                yield row()
                keys, sizes, parts, held, seq = [], [], [], 0, seq + 1
    if parts:
        yield row()


class Group:
    """A group's tokens and its distinct words, pairs and triples; words by their ranks among the numbers of the group's words."""

    def __init__(self, row: dict[str, object], answers: pa.Table, corpus: Corpus) -> None:
        numbers, counts = _known(answers, corpus)
        order = np.argsort(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.numbers, self.of_word = numbers[order], counts[order]
        self.word = rank[unplanes(row["tokens"], np.uint32)]
        self.sizes = np.array(row["sizes"], np.int64)
        self.training = np.repeat(~np.array(row["held"], bool), self.sizes)
        self._find(corpus)

    def _find(self, corpus: Corpus) -> None:
        """Pairs in the order of shards, then of words; triples in the order of their first pairs."""
        n = W.U(len(self.numbers))
        word = self.word.astype(W.U)
        back = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.pair_at, self.triple_at = np.flatnonzero(back >= 1), np.flatnonzero(back >= 2)
        pairs, self.pair = np.unique(word[self.pair_at - 1] * n + word[self.pair_at], return_inverse=True)
        first, second = (pairs // n).astype(np.int64), (pairs % n).astype(np.int64)
        hot = self.of_word[first] > SPREAD * corpus.tokens / corpus.shards
        key = W.mix(self.numbers[first] << W.U(32) | np.where(hot, self.numbers[second], W.U(0)))
        shard = (key >> W.U(32)) * W.U(corpus.shards) >> W.U(32)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]
        self.first, self.second, self.shard = first[order], second[order], shard[order].astype(np.int64)
        which = np.full(len(word), -1)
        which[self.pair_at] = self.pair
        triples, self.triple = np.unique(which[self.triple_at - 1].astype(W.U) * n + word[self.triple_at], return_inverse=True)
        self.context, self.third = (triples // n).astype(np.int64), (triples % n).astype(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair and each triple stands in training texts."""
        return tuple(np.bincount(which[self.training[at]], minlength=size) for at, which, size in ((self.pair_at, self.pair, len(self.first)), (self.triple_at, self.triple, len(self.third))))


# 2. Words.


def _edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard of the key range begins in sorted keys."""
    return np.concatenate([[0], np.searchsorted(keys, np.array([(s << 64) // shards for s in range(1, shards)], W.U)), [len(keys)]]).astype(np.int64)


def _state_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = unpack_keys(row["words"])
            sizes = np.diff(_edges(words, shards))
            has = np.flatnonzero(sizes)
            runs = sizes[has]
            data = B.pack(np.column_stack([runs, runs]), [B.falls(runs, words), unplanes(row["counts"], np.uint32)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), row["g"])), pa.array(has.astype(np.int32)), data], ["g", "shard", "data"])


def _number_words(table: pa.Table) -> pa.Table:
    """A shard's answer to each group: ranks by frequency and counts of its words; and, as group -1, the shard's sizes."""
    sizes, (steps, counts) = B.unpack(table.column("data"), 2)
    keys, where = np.unique(B.rises(sizes[:, 0], steps), return_inverse=True)
    total = np.bincount(where, counts.astype(float), len(keys)).astype(W.U)
    rank = np.empty(len(keys), W.U)
    rank[np.lexsort((keys, ~total))] = np.arange(len(keys), dtype=W.U)
    data = B.pack(sizes, [rank[where], total[where]])
    facts = B.pack(np.full((1, 1), 3), [np.array([len(keys), np.count_nonzero(total), total.sum()], W.U)])
    shard = table.column("shard")[0].as_py()
    return pa.table([pa.array([*table.column("g").to_pylist(), -1], pa.int64()), pa.array([shard] * (len(table) + 1), pa.int32()), pa.concat_arrays([data, facts])], ["g", "shard", "data"])


def corpus_of(numbered: DataFrame, tokens: int, word_shards: int) -> Corpus:
    """The facts of all shards of words: one row from each."""
    facts = numbered.filter("g = -1").select("data").collect()
    each = np.array([B.unpack(pa.array([bytes(r.data)], pa.binary()), 1)[1][0] for r in facts]).astype(np.int64).reshape(-1, 3)
    if each[:, 0].max(initial=0) * word_shards >= 1 << 32:
        raise ValueError("words' numbers do not fit into 32 bits")
    return Corpus(int(each[:, 2].sum()), int(each[:, 1].sum()), word_shards, max(1, -(-tokens // SHARD_TOKENS)))


def _known(answers: pa.Table, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of a group's words, in the order of their keys; frequent words have small numbers."""
    answers = answers.sort_by("shard")
    sizes, (rank, counts) = B.unpack(answers.column("data"), 2)
    return rank * W.U(corpus.word_shards) + np.repeat(answers.column("shard").to_numpy(), sizes[:, 0]).astype(W.U), counts.astype(np.int64)


# 3. Pairs and triples.


def _state_grams(table: pa.Table, answers: pa.Table, corpus: Corpus) -> pa.Table:
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary())], ["g", "shard", "data"])
    row = table.to_pylist()[0]
    group = Group(row, answers, corpus)
    by_pair, by_triple = group.counts()
    u, v, w = group.numbers[group.first], group.numbers[group.second], group.numbers[group.third]
    has, block = np.unique(group.shard, return_inverse=True)
    new = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(group.first, prepend=-1) != 0))  # runs of one first word
    run = np.diff(np.append(new, len(u)))
    follow = np.bincount(group.context, minlength=len(u))
    n_runs, n_pairs = np.bincount(block[new], minlength=len(has)), np.bincount(block, minlength=len(has))
    n_triples = np.bincount(block, follow, len(has)).astype(np.int64)
    data = B.pack(
        np.column_stack([n_runs, n_runs, n_runs, n_pairs, n_pairs, n_pairs, n_triples, n_triples]),
        [B.falls(n_runs, u[new]), run, group.of_word[group.first[new]], B.falls(run, v), by_pair, follow, B.falls(follow[follow > 0], w), by_triple],
    )
    return pa.table([pa.array(np.full(len(has), row["g"])), pa.array(has.astype(np.int32)), data], ["g", "shard", "data"])


def _answer(table: pa.Table, priors: tuple[float, float]) -> pa.Table:
    """A shard: the trie of its pairs' n-grams from the counts of all groups, and its codes for what each group asked."""
    sizes, (us, run, of_u, vs, by_pair, follow, ws, by_triple) = B.unpack(table.column("data"), 8)
    run, follow = run.astype(np.int64), follow.astype(np.int64)
    u, v = B.rises(sizes[:, 0], us), B.rises(run, vs)
    pairs, pair = np.unique(np.repeat(u, run) << W.U(32) | v, return_inverse=True)
    w = B.rises(follow[follow > 0], ws)
    triples, triple = np.unique(np.repeat(pair, follow).astype(W.U) << W.U(32) | w, return_inverse=True)
    two, three = np.bincount(pair, by_pair.astype(float), len(pairs)), np.bincount(triple, by_triple.astype(float), len(triples))
    one = np.zeros(len(pairs))
    one[pair] = np.repeat(of_u, run)
    first, second = (pairs >> W.U(32)).astype(np.int64), (pairs & W.U(0xFFFFFFFF)).astype(np.int64)
    context, third = (triples >> W.U(32)).astype(np.int64), (triples & W.U(0xFFFFFFFF)).astype(np.int64)
    with Trie(first, second, context, third, two, three, one, priors) as trie:
        of_pairs, weights, of_triples = trie.ask(first, second, context, third)
    n_pairs, n_triples = sizes[:, 3], sizes[:, 6]
    data = B.pack(np.column_stack([n_pairs, n_pairs, n_triples]), [of_pairs[pair], weights[pair], of_triples[triple]])
    return pa.table([table.column("g").cast(pa.int64()), table.column("shard").cast(pa.int32()), data], ["g", "shard", "data"])


# 4. Scores.


def _score(table: pa.Table, answers: pa.Table, corpus: Corpus, priors: tuple[float, float]) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
    row = table.to_pylist()[0]
    kind = answers.column("kind")
    group = Group(row, answers.filter(pc.equal(kind, 1)), corpus)
    counts = group.of_word
    _, (of_pairs, weights, of_triples) = B.unpack(answers.filter(pc.equal(kind, 2)).sort_by("shard").column("data"), 3)

    p1 = (counts + 1) / (corpus.tokens + corpus.distinct + 1)
    p2 = Trie.value(of_pairs) + priors[0] / (counts[group.first] + priors[0]) * p1[group.second]
    by_token = p1[group.word]
    by_token[group.pair_at] = p2[group.pair]
    before = np.zeros(len(by_token), np.int64)
    before[group.pair_at] = group.pair
    at = group.triple_at
    by_token[at] = Trie.value(of_triples)[group.triple] + Trie.value(weights)[before[at - 1]] * by_token[at]
    edges = np.concatenate([[0], np.cumsum(group.sizes)])

    def per_text(each: np.ndarray) -> np.ndarray:
        return np.add.reduceat(each, edges[:-1])

    return pa.table([
        pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(group.sizes), pa.array(per_text((counts > 0)[group.word].astype(np.int64))),
        pa.array(per_text(np.log10(p1)[group.word])), pa.array(per_text(np.log10(by_token))),
    ], names)


def by_shard(rows: DataFrame, shards: int, of_task: int) -> GroupedData:
    """Rows by their shard, `of_task` shards to a task: tasks grow in number with the corpus, not in size."""
    lanes = max(1, shards // of_task)
    return rows.withColumn("lane", F.col("shard") % lanes).repartitionById(lanes, "lane").groupBy("lane", "shard")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, priors: tuple[float, float] = (300.0, 3.0)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on ids whose crc32 mod `fold` is not `held`."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % fold == held
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    groups = written(own.mapInArrow(lambda b: group_rows(b, GROUP_BYTES), GROUP_SCHEMA), "lm-groups")
    tokens = groups.agg(F.sum("n")).first()[0] or 0
    word_shards = max(1, -(-tokens // WORD_TOKENS))
    stated = groups.select("g", "words", "counts").mapInArrow(lambda b: _state_words(b, word_shards), "g long, shard int, data binary")
    numbered = written(by_shard(stated, word_shards, 1).applyInArrow(_number_words, "g long, shard int, data binary"), "lm-words")
    corpus = corpus_of(numbered, tokens, word_shards)
    words = numbered.filter("g >= 0")
    facts = groups.agg(F.count("*").alias("n"), (F.coalesce(F.max(F.shiftright("g", 32)), F.lit(0)) + 1).alias("parts")).first()

    def by_group(rows: DataFrame) -> GroupedData:
        lanes = max(1, facts.n // 4)
        lane = F.pmod(F.shiftright("g", 32) + F.col("g").bitwiseAND((1 << 32) - 1) * facts.parts, F.lit(lanes)).cast("int")
        return rows.withColumn("lane", lane).repartitionById(lanes, "lane").groupBy("lane", "g")

    groups = groups.select("g", "ids", "held", "sizes", "tokens")
    grams = by_group(groups).cogroup(by_group(words)).applyInArrow(lambda t, a: _state_grams(t, a, corpus), "g long, shard int, data binary")
    answers = by_shard(grams, corpus.shards, 4).applyInArrow(lambda t: _answer(t, priors), "g long, shard int, data binary")
    both = words.withColumn("kind", F.lit(1)).unionByName(answers.withColumn("kind", F.lit(2)))
    scored = by_group(groups).cogroup(by_group(both)).applyInArrow(lambda t, a: _score(t, a, corpus, priors), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")
