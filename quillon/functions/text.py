"""Text functions as Spark columns; no Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of each language.
STOP_WORDS = {
    "en": """the a an is are was were be been being have has had do does did will would shall should can could may might must
        ought i you he she it we they me him her us them my your his its our their this that these those of in to for with on
        at by from as into through during before after above below between and but or yet so if because although though while
        where when which who whom whose what whatever""",
    "es": """el la los las un una unos unas de del al y o pero sin con por para en a ante bajo desde entre hacia hasta
        mediante según sobre tras durante excepto salvo como lo le les me te se nos os que quien cual cuales cuyo cuya cuyos
        cuyas donde cuando cuanto cuanta es son está están fue fueron ha han había""",
    "eu": """eta edo baina ez bai ere bestela gainera beraz ala bada hura hau berori nor zer nork nori noren non nola noiz
        zergatik zenbat ni zu gu zuek haiek nire zure haren gure zuen haien da dago daude du ditu dute izan egin bat bi guzti
        gutxi oso inoiz beti hemen han hortxe honela hori""",
}
# Words that tell a language beyond its stop words.
DETECT_WORDS = {
    "en": """not no yes there then than here how why all any both each few more most other some such only own same too very
        just now also back still already even once twice again always never often sometimes usually really actually probably
        maybe perhaps sure well good bad new old first last long great little right left big small large next early young
        important different following public able""",
    "es": """qué quién cuál cuáles dónde cuándo cuánto cuánta estoy estamos estáis hay tengo tiene tienen tenemos tenéis hago
        hace hacen hacemos hacéis más muy mucho mucha muchos muchas poco poca pocos pocas todo todos toda todas este esta
        estos estas ese esa esos esas aquel aquella aquellos aquellas mi mis tu tus su sus nuestro nuestra nuestros nuestras
        vuestro vuestra vuestros vuestras si sino también ya aún todavía siempre nunca jamás aquí ahí allí acá allá ahora
        antes después luego pronto tarde temprano bien mal mejor peor cómo porqué porque pues sí no""",
    "eu": """donostia kalean kale kaleak euskal euskara herri etxe etxea izena urte egun baietz ezetz alde arte aurka bezala
        gisa kontra ondo zai aurre bitartean tartean barruan kanpoan gainean azpian aurrean atzean ondoren lehen gero orduan
        orain""",
}


#: Lower-case Latin letters with one mark, and the letters without it, place by place: what FTS5's unicode61 folds.
_LATIN = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
_PARTS = {c: unicodedata.normalize("NFD", c) for c in _LATIN if c == c.lower()}
MARKED = "".join(c for c, parts in _PARTS.items() if len(parts) == 2 and parts[0].isascii())
PLAIN = "".join(_PARTS[c][0] for c in MARKED)


def stop_words(lang: str) -> list[str]:
    return STOP_WORDS.get(lang, "").split()


def detect_words(lang: str) -> list[str]:
    """Stop words and further tell-tale words."""
    return [*stop_words(lang), *DETECT_WORDS[lang].split()]


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_line(text: Column) -> Column:
    """The tokens of a text with one space between them: cheaper to make and to send to Python than an array."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def fold_diacritics(token: Column) -> Column:
    """A lower-cased token without the marks of its Latin letters; most tokens have none and are passed on."""
    return F.when(token.rlike(r"[^\x00-\x7F]"), F.translate(token, MARKED, PLAIN)).otherwise(token)


def _without(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def filter_stop_words(tokens: Column, lang: Column) -> Column:
    """Tokens without the stop words of their language; of an unknown language, unchanged."""
    out = tokens
    for code in STOP_WORDS:
        out = F.when(lang == code, _without(tokens, stop_words(code))).otherwise(out)
    return out


def detect_language(text: Column) -> Column:
    """en, es or eu by characters and words; ties go to en, then es."""
    low, tokens = F.lower(text), tokenize(text)

    def hits(lang: str) -> Column:
        return 2 * F.size(F.filter(tokens, lambda t: t.isin(detect_words(lang))))

    def has(part: str, points: int) -> Column:
        return F.when(low.contains(part), points).otherwise(0)

    en = hits("en")
    es = 10 * F.regexp_count(low, F.lit("[ñ¿¡]")) + 5 * F.regexp_count(low, F.lit("[áéíóúü]")) + hits("es")
    eu = has("tx", 5) + has("tz", 3) + hits("eu")
    return F.when(eu > F.greatest(en, es), "eu").when(es > en, "es").otherwise("en")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")


def path_basename(path: Column) -> Column:
    """After the last slash or backslash, without the last extension if something stands before it, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^(.+)\.[^.]*$", "$1"))


def sanitize_token(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\p{L}\p{Nd}_]", "")


def match_terms(tokens: Column) -> Column:
    """Prefix terms of a query: sanitised, distinct, in order, none empty."""
    return F.array_distinct(F.filter(F.transform(tokens, sanitize_token), lambda t: t != ""))


def estimate_tokens(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight_html(snippet: Column, opening: str = "\x01", closing: str = "\x02") -> Column:
    """Escaped HTML with marks where the sentinels stood."""
    marked = F.replace(html_escape(snippet), F.lit(opening), F.lit("<mark>"))
    return F.replace(marked, F.lit(closing), F.lit("</mark>"))


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_outer_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?s)^(["'])(.*)\1$""", "$2")


def link_slugs(markdown: Column) -> Column:
    """Last path segments of internal Markdown links, in order, each once."""
    targets = F.regexp_extract_all(markdown, F.lit(r"\[[^\]]*\]\(([^)\s]+)"), 1)
    inner = F.filter(targets, lambda t: ~F.lower(t).rlike("^(https?://|mailto:|#)"))
    segments = F.transform(inner, lambda t: F.element_at(F.filter(F.split(F.regexp_replace(t, "[#?].*$", ""), "/"), lambda s: s != ""), -1))
    return F.array_distinct(F.filter(segments, lambda s: s.isNotNull() & (s != "")))


def compose_content(title: Column, body: Column, comments: Column) -> Column:
    """Title, then a body and comments that are not empty, one per line."""
    return F.concat_ws("\n", title, F.nullif(body, F.lit("")), F.filter(comments, lambda c: c != ""))


def item_hash(title: Column, body: Column, comments: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.concat(F.array(title, body), comments)), 256)


def item_path(repository: Column, kind: str, number: Column) -> Column:
    return F.concat(F.lit("gh:"), repository, F.lit("/issues/" if kind == "issue" else "/pull/"), number.cast("string"))


def recency_boost(modified: Column, now: Column, horizon_days: int = 180, most: float = 0.05) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(modified)) / F.lit(8.64e10)
    return F.when(modified.isNull() | (days >= horizon_days), F.lit(1.0)).when(days <= 0, F.lit(1 + most)).otherwise(1 + most * (1 - days / horizon_days))


def chunk_boost(kept: Column) -> Column:
    return F.when(kept >= 3, F.lit(1.04)).when(kept == 2, F.lit(1.02)).otherwise(F.lit(1.0))


def title_boost(title_stems: Column, query_stems: Column, coefficient: float = 0.5) -> Column:
    n = F.size(query_stems)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 + coefficient * F.size(F.array_intersect(title_stems, query_stems)) / n)
