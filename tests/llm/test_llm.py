"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bit_sliced, blocks, exchange, line_rules, mixing, near_dup, ngram_lm, ordinal, packing, shards, substrings, tokenise, toxicity
from quillon.llm import words as W
from quillon.llm.elias_fano import EliasFano
from quillon.llm.session import prepare

SYLLABLES = "ba ne ki lo tu ra me so di va pe no".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) + rng.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(rng.integers(5, 120))) for _ in range(60)]
    passage = prose(rng, 70)
    texts += [texts[0], texts[1] + " extra", f"start {passage} end", f"{passage}\nother words", passage + " " + passage, None, "", " \n\t ", "one", "ñandú é x " * 30, prose(rng, 6000)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", None) for i, t in enumerate(texts)]
    return [*rows, (0, texts[0], "en", "src0", None), (None, "no id here at all", "en", "src1", 5)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = [F.lit("x").alias(c) for c in ("g", "key", "shard", "score", "bands", "size", "kept", "group", "_row", "epoch")]
    return prepare(spark).createDataFrame(rows, SCHEMA).select("*", *clashing).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def cut(text):
    return (text or "").encode().split()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (500, 600), (500, 10**9), (300, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        coded = EliasFano(values, top)
        assert (coded.access(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200)])
        place = np.searchsorted(values, asked)
        known = place < n
        known[known] = values[place[known]] == asked[known]
        assert (coded.find(asked, np.zeros(len(asked), int), np.full(len(asked), n)) == np.where(known, place, -1)).all()


def test_words_of_odd_texts():
    column = pa.array(["a b", None, "", " x\x0by\x1c ", "é ñ"])
    words = W.words_of(W.texts_of(column))
    assert words.per_text.tolist() == [2, 0, 0, 2, 2]
    assert len(set(words.hashes.tolist())) == 6
    assert W.texts_of(column.slice(3)).text(0) == b" x\x0by\x1c "


def test_bit_sliced_search(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)] + [(20, vectors[3][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [1.0, 2.0]), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).repartition(3)
    got = collections.defaultdict(list)
    for r in bit_sliced.search(df, F.col("vec_id") % 20 == 0, k=8, rows=64, queries=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    whole = [(i, np.floor(64 * np.pad(np.array(v), (0, 6 - len(v)))).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in whole if i % 20 == 0}:
        best = []
        for v in [v for i, v in whole if i == q]:
            best += [(-int(w @ v), i) for i, w in whole if i != q]
        assert got[q] == sorted(best)[:8]
    assert bit_sliced.search(df.limit(0), F.lit(True)).count() == 0
    assert bit_sliced.search(df, F.lit(False)).count() == 0


def test_bit_sliced_search_of_large_components(spark):
    df = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1.0, -3.0]), (2, [-2.5e6, 4.0]), (3, [])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in bit_sliced.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 64 * 64 * (10**8 - 3), (0, 2): 64 * 64 * (-25 * 10**13 + 4), (0, 3): 0}


def shingles(text):
    w = cut(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def test_one_link_joins_two_classes():
    """A loose group gives links by its classes, not by its pairs."""
    texts = ["a b c d e f g h", "a b c d e f g h ", "a b c d e f g h  "]
    one = {"key": [b"%d" % i for i in range(3)], "text": texts, "band": [0] * 3, "bands": [[7]] * 3}
    table = pa.concat_tables([pa.table(one | {"side": [side] * 3, "label": [label] * 3, "main": [side == 1] * 3}) for side, label in ((0, b"x"), (1, b"y"))])
    assert near_dup._links(table, 5, (4, 5)).num_rows == 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = " ".join(rng.choice(list("abc"), 300))
    b = " ".join([*a.split()[:240], *rng.choice(list("abc"), 100)])
    signature = near_dup.signatures(*near_dup.shingles_of(W.texts_of(pa.array([a, b])), 5), 2, 20000)
    assert abs((signature[0] == signature[1]).mean() - likeness(shingles(a), shingles(b))) < 0.015


def brute_classes(pairs):
    """id -> class of (id, text) rows, by all pairs."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in pairs]
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] or "") == (pairs[j][1] or "") or sets[i] and likeness(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i if i is not None else -1), least.get(root(k), -1) if least.get(root(k)) is not None else -1) for k, (i, _) in enumerate(pairs))


def test_near_duplicates(spark, docs, rows):
    got = sorted(((-1 if r.doc_id is None else r.doc_id), (-1 if r.class_id is None else r.class_id)) for r in near_dup.classes(docs).collect())
    assert got == brute_classes([(r[0], r[1]) for r in rows])


def test_near_duplicates_of_a_spread_group(spark):
    """Copies of one base that are less like each other than like the base: hubs leave some for the blocks."""
    rng = np.random.default_rng(5)
    base = prose(rng, 100).split()
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            words[at] = f"changed{i}x{at}"
        texts.append((i, " ".join(words)))
    df = prepare(spark).createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in near_dup.classes(df, hubs=1, block=7).collect())
    assert got == brute_classes(texts)


def test_near_duplicates_of_nothing(none):
    assert near_dup.classes(none).count() == 0


def test_ngram_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 2_000)
    monkeypatch.setattr(ngram_lm, "WORD_TOKENS", 3_000)
    got = collections.defaultdict(list)
    s2, s3 = 7.0, 0.5
    for r in ngram_lm.score_texts(docs, priors=(s2, s3)).collect():
        got[r.doc_id].append(r)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = [collections.Counter() for _ in range(3)]
    tokens = [(r[0], [*cut(r[1] and r[1].encode().translate(low).decode()), None]) for r in rows]
    for i, w in tokens:
        if not held(i):
            for n, c in enumerate(counts):
                c.update(zip(*(w[k:] for k in range(n + 1)), strict=False))
    one, two, three = counts
    n, v = sum(one.values()), len(one)
    better = 0.0
    for i, w in tokens:
        base = score = 0.0
        for j, a in enumerate(w):
            p = (one[a,] + 1) / (n + v + 1)
            base += math.log10(p)
            if j:
                p = (two[w[j - 1], a] + s2 * p) / (one[w[j - 1],] + s2)
            if j > 1:
                p = (three[w[j - 2], w[j - 1], a] + s3 * p) / (two[w[j - 2], w[j - 1]] + s3)
            score += math.log10(p)
        r = min(got[i], key=lambda r: abs(r.base_score - base))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(one[a,] > 0 for a in w), n, held(i))
        assert r.base_score == pytest.approx(base, abs=1e-6) and abs(r.score - score) <= 0.07 * len(w)
        better += r.score - r.base_score
    assert better > 0
    assert ngram_lm.score_texts(docs.limit(0)).count() == 0


def test_ngram_blocks_are_no_more_than_keys(rows):
    """Blocks between groups and shards grow with the keys, not with groups times shards."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows]), "held_out": pa.array([False] * len(rows))})
    groups = pa.Table.from_batches(list(ngram_lm.group_rows(iter([batch]), 1 << 30)))
    stated = pa.Table.from_batches(list(ngram_lm._state_words(iter(groups.to_batches()), 1)))
    numbered = ngram_lm._number_words(stated)
    words = numbered.filter(pa.compute.greater_equal(numbered["g"], 0))
    pairs = 0
    for many in (4, 1 << 20):
        found = ngram_lm._state_grams(groups, words, ngram_lm.Corpus(10, 10, 1, many))
        sizes, _ = blocks.unpack(found["data"], 8)
        pairs = pairs or sizes[:, 3].sum()
        assert sizes[:, 3].sum() == pairs and found.num_rows <= min(many, pairs) and sizes[:, 3].min() > 0
    assert found.num_rows > 1000


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(0, 6, (rng.integers(1, 20), rng.integers(1, 5)))
        sections = [rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 63, n).astype(np.uint64) for n in sizes.sum(axis=0)]
        got, back = blocks.unpack(blocks.pack(sizes, sections), sizes.shape[1])
        assert (got == sizes).all() and all((x == y).all() for x, y in zip(back, sections, strict=True))
    runs, rising = np.array([2, 3]), np.array([5, 9, 1, 2, 2**63], np.uint64)
    assert (blocks.rises(runs, blocks.falls(runs, rising)) == rising).all()


def test_shards(docs, rows, none):
    got = shards.assign(docs, shards=4, cell_groups=16).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = sorted(len((r[1] or "").encode()) + 16 for r in rows)
    assert sorted(got["size"]) == sizes
    assert got.groupby(["text_crc32", "size"]).shard.nunique().max() == 1 or sizes[-1] > sum(sizes) / 4
    assert shards.assign(none).count() == 0


def test_shards_are_those_of_the_dot_products(spark):
    """All groups are heavy here: the placing is recomputed group by group, from the largest down."""
    rng = np.random.default_rng(9)
    texts = [prose(rng, int(rng.integers(3, 60))) for _ in range(90)]
    rows = [(i, texts[i if i < 90 else i % 20]) for i in range(130)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    groups = df.groupBy("text").agg(F.count("*").alias("n"), F.first(F.xxhash64("text")).alias("h")).collect()
    vectors = {g.text: np.array([g.n * (len(g.text.encode()) + 16), g.n * len(cut(g.text)), g.n], float) for g in groups}
    total = sum(vectors.values())
    assert all((v / total).max() <= 0.9 / 8 for v in vectors.values())
    room, want = np.full((8, 3), 1 / 8), {}
    for g in sorted(groups, key=lambda g: (-(vectors[g.text] / total).max(), g.h)):
        v = vectors[g.text] / total
        want[g.text] = int(np.argmax([sum(r * x * w for r, x, w in zip(room[s], v, shards.WEIGHTS, strict=True)) for s in range(8)]))
        room[want[g.text]] -= v
    got = {r.doc_id: r.shard for r in shards.assign(df, shards=8).collect()}
    assert got == {i: want[t] for i, t in rows}


@pytest.mark.parametrize("case", ["empty texts", "one id"])
def test_shards_balance_all_measures(spark, case):
    """Very many empty texts, or very many rows of one id, weigh in rows or in all: they part."""
    rng = np.random.default_rng(10)
    same = prose(rng, 50)
    rows = [(i, "" if i < 900 else prose(rng, int(rng.integers(5, 80)))) for i in range(2400)] if case == "empty texts" else [(1, same)] * 1200 + [(None, same)] * 300 + [(i, prose(rng, int(rng.integers(5, 80)))) for i in range(400)]
    got = shards.assign(prepare(spark).createDataFrame(rows, "doc_id long, text string"), shards=10).toPandas()
    for column, how in (("size", "sum"), ("tokens", "sum"), ("slot", "count")):
        each = got.groupby("shard")[column].agg(how)
        assert len(each) == 10 and 0.97 < each.min() / each.mean() and each.max() / each.mean() < 1.03
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))


def test_a_group_larger_than_a_shard_is_split(spark):
    df = prepare(spark).createDataFrame([(i, "same text" if i < 400 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    got = shards.assign(df, shards=8).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and (by.max() - by.min()) / by.mean() < 0.1
    assert got[got.doc_id >= 400].groupby("text_crc32").shard.nunique().max() == 1


def test_line_rules(docs, rows, none):
    got = collections.defaultdict(list)
    for r in line_rules.line_first_clean(docs).collect():
        got[r.doc_id].append(r)
    for i, text, *_ in rows:
        words = cut(text)
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        windows = collections.defaultdict(list)
        for p in range(len(words) - 7):
            windows[tuple(words[p : p + 8])].append(p)
        twice = {q for ps in windows.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        chars = sum(len(w.decode()) for w in words)
        want = (len(words), chars, sum((text or "").count(c) for c in line_rules.SYMBOLS), len(lines) - len(set(lines)), len(twice), len(words) < 20 or 100 * len(twice) > 30 * len(words))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got[i]]
    assert line_rules.line_first_clean(none).count() == 0


def test_line_rules_do_not_depend_on_neighbours(spark):
    """A phrase is one of a line, wherever texts stand in a batch; letters with marks do not close a fragment."""
    line = "this line of plain prose is long enough to be kept by all the rules, please click"
    pairs = [(1, line + " on the word with twenty words or more in this text of ours, then click"), (2, " here it goes on with more words than that and it is a text of its own, with more than twenty words of plain prose."), (3, "café\n" + line), (4, "«Voilà»\n" + line), (5, "read\nmore\n" + line)]
    frame = lambda rows: {r.doc_id: r for r in line_rules.line_first_clean(prepare(spark).createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    together, alone = frame(pairs), {k: v for p in pairs for k, v in frame([p]).items()}
    assert together == alone and together[1].kept and together[1].n_removed_lines == 0
    assert together[3].n_removed_lines == 1 and together[4].n_removed_lines == 0 and together[5].n_removed_lines == 2


def brute_verdict(text, rules):
    """The rules of a text, line by line, as they are stated."""
    lines, gone, kept = [x.encode() for x in (text or "").split("\n") if x.encode().split()], 0, 0
    for line in lines:
        words = line.split()
        n = len(words)
        symbols = sum(line.count(c.encode()) for c in line_rules.SYMBOLS if c != "|")
        small, capital = sum(97 <= b <= 122 for b in line), sum(65 <= b <= 90 for b in line)
        bad = symbols > rules.most_symbols * n or line.count(b"!") > rules.most_shouted * n and capital > small
        bad = bad or n <= rules.fragment_words and not words[-1].decode().endswith(tuple(line_rules.CLOSING))
        bad = bad or line.count(b"|") > max(1, rules.most_separators * n)
        bad = bad or n >= rules.stutter_words and sum(a == b for a, b in zip(words, words[1:])) > rules.most_stuttered * n
        bad = bad or any(p.encode() in line.lower() for p in line_rules.BOILERPLATE)
        gone += bad * sum(map(len, words))
        kept += (not bad) * n
    total = sum(len(w) for x in lines for w in x.split())
    return kept, gone <= rules.most_lost * total and kept >= rules.least_words


def test_line_verdicts(spark, rows):
    rng = np.random.default_rng(11)
    odd = ["Home | About | Help", "READ THIS!!! NOW!!!", "# $ % & text", "click here", "Mehr erfahren", "short line", "the the the the the the the the", "ok.", "«bien»", "leer más aquí"]
    texts = [r[1] for r in rows] + ["\n".join(prose(rng, int(rng.integers(1, 30))) if rng.random() < 0.6 else str(rng.choice(odd)) for _ in range(int(rng.integers(1, 12)))) for _ in range(200)]
    got = {r.doc_id: r for r in line_rules.line_first_clean(prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    verdicts = [brute_verdict(t, line_rules.LineRules()) for t in texts]
    assert [(got[i].n_kept_words, got[i].kept) for i in range(len(texts))] == [(n, good and not got[i].base_failed) for i, (n, good) in enumerate(verdicts)]
    assert 0 < sum(good for _, good in verdicts) < len(texts)


def test_line_rules_remove_lines_and_reject(spark):
    good = "This is a line of ordinary prose with a dozen words in it.\n" * 3
    cases = {1: good + "Home | About | Contact | Help\nAll rights reserved.\n" + good.replace("This", "That"), 2: "A | b | c | d | e | f | g | h | i | j | k | l | m | n\n" * 3, 3: "WORD!! " * 30, 4: "".join(f"w{i}$$$ " for i in range(40)), 5: "stutter " * 15 + "again " * 15}
    got = {r.doc_id: r for r in line_rules.line_first_clean(prepare(spark).createDataFrame(list(cases.items()), "doc_id long, text string"), rules=line_rules.LineRules(base_repeated=100)).collect()}
    assert got[1].kept and got[1].n_removed_lines == 2 and "rights" not in got[1].cleaned_text and "ordinary" in got[1].cleaned_text
    assert not any(got[i].kept for i in (2, 3, 4, 5))


VOCABULARY = tokenise.vocabulary_path("byte_bpe_50k.json")


def test_token_ids_are_those_of_whole_texts(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    texts = [r[1] for r in rows] + ["  a", "a  b \n c", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "日本 語 です ", "\n\n x \t y", "it's o'k 12 34 ... !", "¿que ¡no «x» ", "\x1c a \x1d", "\u0085 y \u0085 z", "é   b"]
    ids, edges = tokenise.token_ids(W.texts_of(pa.array(texts)), VOCABULARY)
    for i, text in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_first_fit_decreasing_is_what_a_scan_gives():
    sizes = np.sort(np.random.default_rng(4).integers(1, 60, 200))[::-1]
    bins = []
    want = []
    for s in sizes.tolist():
        at = next((i for i, room in enumerate(bins) if room >= s), len(bins))
        bins[at:] = bins[at:] or [64]
        bins[at] -= s
        want.append(at)
    assert packing.first_fit_decreasing(sizes, 64)[0].tolist() == want


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(docs, group_docs=20).toPandas()
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[-1 if i is None else i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    assert want == collections.Counter((-1 if math.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 1024
    assert packing.pack(none).count() == 0


def test_packing_keeps_large_ids_beside_a_null_and_spreads_equal_rows(spark):
    odd = (1 << 60) + 1
    rows = [(odd, "a b c"), (None, "d <|endoftext|> e")] + [(7, "same")] * 400
    got = packing.pack(prepare(spark).createDataFrame(rows, "doc_id long, text string"), group_docs=50)
    assert {r.doc_id for r in got.collect()} == {odd, None, 7}
    per_group = got.groupBy(F.shiftright("sequence_id", 32)).count().toPandas()["count"]
    assert len(per_group) == 9 and per_group.max() < 100


def test_packing_pads_little(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, int(rng.integers(5, 900)))) for i in range(400)]
    got = packing.pack(prepare(spark).createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.97


def labelled(n=300, seed=6):
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for _ in range(n):
        t = prose(rng, 60).split()
        bad = rng.random() < 0.3
        if bad:
            for at in rng.choice(60, 8, replace=False):
                t[at] = str(rng.choice(["zwurgh", "xyqqor", "grumblox"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_held_out_texts(spark):
    texts, toxic = labelled()
    docs = prepare(spark).createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.93
    assert 0 <= got[1000].score < 0.5 and len(got) == len(texts) + 2
    plain = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_texts(docs, plain).agg(F.countDistinct("score")).first()[0] == 1
    assert toxicity.score_texts(docs.limit(0), plain).count() == 0


def test_toxicity_scores_are_those_of_the_windows(spark):
    """Scores again, window by window, with compressors of their own; among the texts empty and very long ones."""
    import zstandard

    texts, toxic = labelled(200, 12)
    model = toxicity.fit([(i, y, t) for i, (y, t) in enumerate(zip(toxic, texts, strict=True))], {0: 150, 1: 50})
    assert model.ordinary and model.toxic
    size = lambda content, part: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False).compress(part))
    some = [*texts[:12], "", None, "x", " ".join(texts[:100])]
    got = {r.doc_id: r for r in toxicity.score_texts(prepare(spark).createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(some):
        raw = (text or "").encode()
        parts = [raw[a : a + 32] for a in range(0, max(1, len(raw) - 16), 16)]
        gains = [size(model.ordinary, p) - size(model.ordinary + model.toxic, p) for p in parts]
        x = [math.log1p(sum(g > k for g in gains)) for k in range(1, 13)] + [math.log(len(gains)), max(gains), sum(gains) / len(gains)]
        z = model.weights[0] + sum(w * (a - c) for w, a, c in zip(model.weights[1:], x, model.centre, strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[i].predicted == (got[i].score >= 0.5)
    assert got[15].score > 0.5


def test_a_class_of_one_text_gives_the_share(spark):
    model = toxicity.fit([(1, 1, "bad"), (2, 0, "good words"), (3, 0, "more words")], {0: 2, 1: 1})
    assert model.score(np.zeros((1, 15)))[0] == pytest.approx(1.5 / 4)


def test_repeated_rows_do_not_push_out_labelled_texts(spark):
    from quillon.llm.samples import labelled_sample

    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "two"), (3, "three"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    found, sizes = labelled_sample(docs, labels, F.col("toxic"), F.lit(True), 3, [0, 1])
    assert found == [(1, 0, "again"), (2, 1, "two"), (3, 0, "three"), (4, 1, "")] and sizes == {0: 2, 1: 2}


def test_repeats_of_many_rows_of_one_id(spark, monkeypatch):
    """Texts of one id, or of none, are dealt to several groups; every repeated window stays once."""
    monkeypatch.setattr(exchange, "GROUP_BYTES", 3_000)
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(7 if i % 2 else None, f"{' '.join(f'r{i}w{k}' for k in range(int(rng.integers(20, 40))))} {passage} end{i}") for i in range(40)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    own, groups = exchange.grouped(df, "doc_id", "text")
    assert groups > 3 and own.filter("doc_id IS NULL").select("g").distinct().count() > 1
    got = substrings.remove_repeats(df).collect()
    assert sum(passage in r.kept_text for r in got) == 1 and sum(r.n_removed for r in got) == 39 * 30
    assert all(f"end{i}" in " ".join(r.kept_text for r in got) for i in range(40))


def test_repeats(docs, rows, none, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 3_000)
    got = collections.Counter((-2**63 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substrings.remove_repeats(docs).collect())
    seen, want = set(), collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: (-2**63 if r[0] is None else r[0], r[1] or "")):
        w = cut(text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[-2**63 if i is None else i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert got == want
    assert substrings.remove_repeats(none).count() == 0


def test_budgets_go_to_siblings_first():
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 100}
    assert mixing.budgets(supply, {}, 200, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "x", "4"): 100}
    assert mixing.budgets(supply, {("b",): 0.0}, 400, 1)["b", "x", "4"] == 0
    assert sum(mixing.budgets(supply, {}, 10**6, 2).values()) == 620
    with pytest.raises(ValueError):
        mixing.budgets(supply, {("a",): -1.0}, 1, 1)


def test_mix(docs, rows, none):
    weights = {("d", "en"): 3.0}
    got = mixing.mix(docs, F.lit("d"), weights, share=0.9, epochs=3).toPandas()
    tokens = lambda part: sum(len(cut(t)) for t in part)
    supply = collections.Counter()
    for _, text, lang, source, _ in rows:
        supply["d", lang, source] += len(cut(text))
    plan = mixing.budgets(supply, weights, 0.9 * sum(supply.values()), 3)
    for (_, lang, source), budget in plan.items():
        part = got[(got.lang.isna() if lang is None else got.lang == lang) & (got.source == source)]
        whole = budget // max(1, supply["d", lang, source])
        assert tokens(part.text) <= budget
        assert all(tokens(part[part.epoch == e].text) == supply["d", lang, source] for e in range(whole))
    assert set(docs.columns) == set(got.columns)
    again = mixing.mix(docs, F.lit("d"), weights, share=0.9, epochs=3).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.values.tolist()))
    assert mixing.mix(none, F.lit("d"), {}).count() == 0


def test_mix_takes_the_documents_of_the_seeded_order(docs, rows):
    """Which documents are taken, leaf by leaf, from their hashes in order; no empty text beyond the whole epochs."""
    weights, total = {("d", "en"): 3.0}, sum(len(cut(r[1])) for r in rows)
    for share, epochs in ((0.9, 3), (0.5, 1), (1.0, 1)):
        got = collections.Counter((r.doc_id, r.text, r.epoch) for r in mixing.mix(docs, F.lit("d"), weights, share=share, epochs=epochs).collect())
        supply = collections.Counter()
        for _, text, lang, source, _ in rows:
            supply["d", lang, source] += len(cut(text))
        plan = {k: divmod(b, supply[k]) if supply[k] else (1, 0) for k, b in mixing.budgets(supply, weights, share * total, epochs).items()}
        text = F.coalesce("text", F.lit(""))
        keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64(F.col("doc_id").cast("string"), text).alias("hash"))
        for e in range(epochs + 1):
            keyed = keyed.withColumn(f"h{e}", F.pmod(F.xxhash64(F.lit(29), F.lit(e), "hash"), F.lit(mixing.HASHES)))
        want, leaves = collections.Counter(), collections.defaultdict(list)
        for r in keyed.collect():
            leaves["d", r.lang, r.source].append(r)
        for leaf, members in leaves.items():
            full, rest = plan[leaf]
            want.update((r.doc_id, r.text, e) for r in members for e in range(full))
            taken = 0
            for r in sorted(members, key=lambda r: (r[f"h{full}"], r.hash)) if rest else []:
                taken += len(cut(r.text))
                if taken > rest:
                    break
                want[r.doc_id, r.text, full] += 1
        assert got == want


def test_mix_keeps_leaves_without_tokens(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, None, "en", "empty"), (3, " ", "en", "empty"), (4, "", "de", "off")], "doc_id long, text string, lang string, source string")
    for share, epochs in ((1.0, 1), (1.0, 2), (2.0, 2)):
        got = mixing.mix(docs, F.lit("d"), {("d", "de"): 0.0}, share=share, epochs=epochs)
        assert sorted((r.doc_id, r.epoch) for r in got.filter("doc_id > 1").collect()) == [(2, 0), (3, 0)]


def test_ordinal_grades(spark):
    rng = np.random.default_rng(8)
    marks = ["bad", "fair", "fine"]
    texts, grades = [], []
    for _ in range(400):
        g = int(rng.integers(0, 3))
        words = prose(rng, 40).split()
        for at in rng.choice(40, 10, replace=False):
            words[at] = marks[g]
        texts.append(" ".join(words))
        grades.append(g)
    docs = prepare(spark).createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([*enumerate(grades), (5, None), (7000, 2)], "doc_id long, grade int")
    model = ordinal.train(docs, ratings, F.col("grade"), [0, 1, 2], F.col("id") % 5 != 0)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in ordinal.grade_texts(docs, model, tail=2).collect()}
    held = range(0, 400, 5)
    assert np.mean([got[i].grade == grades[i] for i in held]) > 0.9
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in got.values())
    assert ordinal.grade_texts(docs, ordinal.train(docs, ratings.limit(0), F.col("grade"), [0, 1, 2]), tail=1).filter("grade <> 0").count() == 0
    assert ordinal.grade_texts(docs.limit(0), model, tail=1).count() == 0
