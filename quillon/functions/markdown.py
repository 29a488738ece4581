"""Markdown documents: front matter, plain text, first heading, taxonomy terms; and chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import link_slugs

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def front_matter(source: str) -> tuple[dict, str]:
    """Fields and body; the closing mark may stand anywhere after the opening one."""
    import yaml

    if not source.startswith("---"):
        return {}, source
    end = source.find("---", 3)
    if end < 0:
        return {}, source
    fields = yaml.safe_load(source[3:end]) or {}
    return fields if isinstance(fields, dict) else {}, source[end + 3 :]


def split_front_matter(source: str) -> tuple[dict, str]:
    """The other reading: the closing mark must begin a line."""
    import yaml

    found = re.match(r"---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", source, re.S | re.M)
    if not found:
        return {}, source
    try:
        fields = yaml.safe_load(found[1]) or {}
    except yaml.YAMLError:
        fields = {}
    return fields if isinstance(fields, dict) else {}, source[found.end() :]


def _inline(text: str) -> str:
    """Text of a line without code spans and marks."""
    text = re.sub(r"(`+)(?:(?!\1).)+?\1", "", text)
    text = re.sub(r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^>]*>", "", text)
    return re.sub(r"(\*\*\*|\*\*|\*|___|__|(?<!\w)_|_(?!\w)|~~)", "", text)


def plain_text(body: str) -> tuple[str, str]:
    """Text outside code, white space collapsed, and the first level-1 heading."""
    parts: list[str] = []
    heading, fence, before_blank = "", "", True
    for line in body.splitlines():
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                fence = ""
            continue
        if found := _FENCE.match(line):
            fence = found[1]
            continue
        if before_blank and re.match(r"^(?: {4}|\t)\S", line):
            continue
        before_blank = not line.strip()
        if found := _HEADING.match(line):
            text = _inline(found[2] or "")
            heading = heading or (text.strip() if len(found[1]) == 1 else "")
        else:
            text = _inline(re.sub(r"^[ \t]*(?:>[ \t]?)*(?:[-*+][ \t]+|\d{1,9}[.)][ \t]+)?", "", line))
            if re.match(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$", line):
                text = ""
        parts.append(text)
    return " ".join(" ".join(parts).split()), heading


def parse(source: str, default_lang: str = "en") -> dict[str, str]:
    """title, lang, text of a Markdown document."""
    fields, body = front_matter(source)
    text, heading = plain_text(body)
    return {"title": str(fields.get("title") or heading), "lang": str(fields.get("lang") or default_lang), "text": text}


def taxonomy_terms(fields: dict, names: Sequence[str]) -> list[str]:
    """Terms of list fields: strings, or of a mapping its slug, else name|value, else value, else name."""
    found: set[str] = set()
    for name in names:
        for item in fields.get(name) or [] if isinstance(fields.get(name), list) else []:
            if isinstance(item, str):
                found.add(item)
            elif isinstance(item, dict):
                slug, label, value = (str(item.get(k) or "") for k in ("slug", "name", "value"))
                found.add(slug or (f"{label}|{value}" if label and value else value or label))
    return sorted(found - {""})


def _cut_long(paragraph: str, most: int) -> list[str]:
    """Pieces of a paragraph: cut at the last white space in the upper half of the limit, else between characters at the limit."""
    raw, out = paragraph.encode(), []
    while len(raw) > most:
        at = max(raw.rfind(c, most // 2 + 1, most + 1) for c in (b" ", b"\n", b"\t"))
        if at < 0:
            at = most
            while at > 1 and raw[at] & 0xC0 == 0x80:
                at -= 1
        out.append(raw[:at].decode().strip())
        raw = raw[at:].decode().strip().encode()
    return [*out, raw.decode()] if raw else out


def chunk(text: str, most: int = 1500) -> list[str]:
    """Pieces of at most `most` bytes: whole paragraphs together; one too long for a piece has pieces of its own."""
    text = text.strip()
    if len(text.encode()) <= most:
        return [text] if text else []
    out: list[str] = []
    held = ""
    for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
        joined = f"{held}\n\n{paragraph}" if held else paragraph
        if len(joined.encode()) <= most:
            held = joined
            continue
        out += [held] if held else []
        alone = len(paragraph.encode()) <= most
        held = paragraph if alone else ""
        out += [] if alone else _cut_long(paragraph, most)
    return [*out, held] if held else out


def default_single_chunk(docs: DataFrame, chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """chunks and, for documents with an embedding of their own and no chunk, their whole text as chunk 0; neither is an error."""
    rest = docs.join(chunks.select(F.col("doc_id").alias("id")), "id", "left_anti")
    checked = F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no chunks and no embedding: "), F.col("id").cast("string")))).otherwise(F.col("embedding"))
    own = rest.select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col(text_col).alias("text"), checked.alias("embedding"))
    return chunks.select("doc_id", "chunk_index", "text", "embedding").unionByName(own)


def front_matter_walk(files: DataFrame, docs: DataFrame, fields: Sequence[str], content_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """Documents' slugs and taxonomy, and the links between them, from Markdown files (path relative to a folder, content).

    A file's document has its path, or its path below `content_dir`, or else its file name (the smallest id of several);
    its slug is the field or the file's stem.  Links are last path segments of internal links that are slugs of other
    documents.  (doc_id, slug, taxonomy) and (src, dst).
    """
    schema = "path string, slug string, taxonomy array<string>, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                meta, body = split_front_matter(content or "")
                slug = meta.get("slug") if isinstance(meta.get("slug"), str) else ""
                rows.append((path, slug or re.sub(r"\.md$", "", path.rsplit("/", 1)[-1]), taxonomy_terms(meta, fields), body))
            yield pd.DataFrame(rows, columns=["path", "slug", "taxonomy", "body"])

    base = lambda c: F.element_at(F.split(c, "/"), -1)
    read = files.select("path", "content").mapInPandas(run, schema)
    below = F.concat(F.lit(content_dir.rstrip("/") + "/" if content_dir else ""), F.col("path"))
    keys = read.select("path", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("path").alias("key")), F.struct(F.lit(1).alias("way"), below.alias("key")))).alias("k")).select("path", "k.*")
    known = docs.select(F.col("id").alias("doc_id"), F.col("path").alias("key"))
    direct = keys.join(known, "key").select("path", "way", "doc_id")
    by_name = read.select("path", base(F.col("path")).alias("key")).join(known.groupBy(base(F.col("key")).alias("key")).agg(F.min("doc_id").alias("doc_id")), "key").select("path", F.lit(2).alias("way"), "doc_id")
    found = direct.unionByName(by_name).groupBy("path").agg(F.min(F.struct("way", "doc_id"))["doc_id"].alias("doc_id"))
    joined = read.join(found, "path")
    slugs = joined.groupBy("slug").agg(F.min("doc_id").alias("dst"))
    links = joined.select(F.col("doc_id").alias("src"), F.explode(link_slugs(F.col("body"))).alias("slug")).join(slugs, "slug").filter("src <> dst").select("src", "dst").distinct()
    return joined.select("doc_id", "slug", "taxonomy"), links


def parse_all(files: DataFrame, content: str = "content", default_lang: str = "en") -> DataFrame:
    """path, title, lang, text of files with Markdown in a string column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **parse(s, default_lang)} for p, s in zip(batch.path, batch.content, strict=True)], columns=["path", "title", "lang", "text"])

    return files.selectExpr("path", f"{content} AS content").mapInPandas(run, "path string, title string, lang string, text string")


def chunk_all(docs: DataFrame, text_col: str = "content", most: int = 1500) -> DataFrame:
    """doc_id, chunk_index, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, piece) for i, text in zip(batch.doc_id, batch.text, strict=True) for n, piece in enumerate(chunk(text or "", most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return docs.selectExpr("id AS doc_id", f"{text_col} AS text").mapInPandas(run, "doc_id long, chunk_index int, text string")
