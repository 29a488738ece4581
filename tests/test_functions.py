import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import embed, markdown, stem
from quillon.functions import text as T


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, "i int, s string").orderBy("i").select(*columns).collect()]


def test_text_columns(spark):
    s = F.col("s")
    rows = [(1, "Hello, Wörld_2!"), (2, ""), (3, None), (4, '"quoted text"'), (5, "a  b\n c")]
    out = values(spark, rows, T.tokenize(s), T.slugify(s), T.estimate_tokens(s), T.strip_outer_quotes(s), T.clean_whitespace(s))
    assert out[0][:3] == (["hello", "wörld", "2"], "hello-wörld-2", 4)
    assert out[1][:3] == ([], "", 0)
    assert out[2] == (None, None, None, None, None)
    assert out[3][3] == "quoted text"
    assert out[4][4] == "a b c"


def test_path_basename(spark):
    rows = [(1, "/a/b/Go-Intro.MD"), (2, "c\\d.tar.gz"), (3, "/x/.hidden"), (4, "plain")]
    assert [r[0] for r in values(spark, rows, T.path_basename(F.col("s")))] == ["go-intro", "d.tar", ".hidden", "plain"]


def test_detect_language(spark):
    rows = [(1, "how to install the program"), (2, "cómo instalar el programa"), (3, "nola instalatu etxea"), (4, "x y z"), (5, "¿qué?")]
    assert [r[0] for r in values(spark, rows, T.detect_language(F.col("s")))] == ["en", "es", "eu", "es", "es"]


def test_link_slugs(spark):
    body = "[a](/docs/intro/) [b](https://x.org/y) [c](guide.md#top) [d](#here) [e](/docs/intro?x=1) [f](mailto:a@b)"
    assert values(spark, [(1, body)], T.link_slugs(F.col("s")))[0][0] == ["intro", "guide.md"]


def test_highlight_escapes_before_marking(spark):
    assert values(spark, [(1, "a < \x01b\x02 & 'c'")], T.highlight_html(F.col("s")))[0][0] == "a &lt; <mark>b</mark> &amp; &#39;c&#39;"


@pytest.mark.parametrize(("word", "expected"), [
    ("running", "run"), ("flies", "fli"), ("caresses", "caress"), ("generously", "generous"), ("skies", "sky"), ("happiness", "happi"), ("relational", "relat"),
    ("hopping", "hop"), ("hoping", "hope"), ("controlled", "control"), ("by", "by"), ("nationally", "nation"), ("cries", "cri"), ("agreed", "agre"), ("sensational", "sensat"), ("programming", "program"),
])
def test_stem_en(word, expected):
    assert stem.stem_en(word) == expected


@pytest.mark.parametrize(("word", "expected"), [("corriendo", "corr"), ("rápidamente", "rapid"), ("casas", "cas"), ("canciones", "cancion"), ("libros", "libr"), ("haciéndolo", "hac"), ("posibilidades", "posibil"), ("y", "y")])
def test_stem_es(word, expected):
    assert stem.stem_es(word) == expected


def test_stem_texts_keeps_order_and_unknown_languages(spark):
    docs = spark.createDataFrame([(1, "en", "The running dogs are running"), (2, "de", "Die Hunde"), (3, "en", "the"), (4, "es", "los libros")], "id long, lang string, content string")
    got = {r.id: r.stemmed for r in stem.stem_texts(docs).collect()}
    assert got == {1: "run dog run", 2: "die hunde", 3: "", 4: "libr"}


def test_markdown():
    parsed = markdown.parse("---\ntitle: T\nlang: eu\n---\n# Head `x`\n\nSome *bold* text `code`.\n\n```go\nfunc()\n```\n\n- item [link](u)\n\n    indented code\n")
    assert parsed == {"title": "T", "lang": "eu", "text": "Head Some bold text . item link"}
    assert markdown.parse("# Only\n\nBody")["title"] == "Only"
    assert markdown.front_matter("---\ntitle: x")[0] == {}
    assert markdown.split_front_matter("---\na: 1\nb: x---y\n---\nrest") == ({"a": 1, "b": "x---y"}, "rest")
    assert markdown.taxonomy_terms({"tags": ["b", {"slug": "a"}, {"name": "n", "value": "v"}]}, ["tags"]) == ["a", "b", "n|v"]


def test_chunks_are_bounded_and_whole():
    text = "\n\n".join(f"palabra{i} " + "ñandú " * i for i in range(80))
    pieces = markdown.chunk(text, 300)
    assert all(len(p.encode()) <= 300 for p in pieces)
    assert " ".join(pieces).split() == text.split()
    assert markdown.chunk("") == [] and markdown.chunk("ab") == ["ab"]
    assert "".join(markdown.chunk("ñ" * 1000, 101)) == "ñ" * 1000


def test_mock_embedding():
    a, b = embed.mock("go"), embed.mock("go")
    assert np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-5 and len(a) == 384
    assert not embed.mock("").any()
    embed.validate(embed.provider("mock"))
    with pytest.raises(ValueError):
        embed.provider("")


def test_item_content(spark):
    rows = spark.createDataFrame([("t", "", ["a", "", "b"]), ("", "x", [])], "title string, body string, comments array<string>")
    out = rows.select(T.compose_content(F.col("title"), F.col("body"), F.col("comments")), T.item_hash(F.col("title"), F.col("body"), F.col("comments"))).collect()
    assert [r[0] for r in out] == ["t\na\nb", "\nx"]
    assert out[0][1] == hashlib.sha256(b"t\n\na\n\nb").hexdigest()
