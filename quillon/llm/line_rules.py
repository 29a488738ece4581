"""Line-first cleaning: rules judge lines, failed lines go, texts that lose too much are rejected.

Every line of a text (split at ``\\n``) that holds a word is judged by three
families of rules:

* punctuation: too many symbol characters or shouted words for its words, or a
  short fragment without a closing mark;
* navigation: separators of menus and breadcrumbs between its words;
* boilerplate: a fixed phrase of web furniture, or mostly stuttered words.

Lines that fail are removed.  A text is rejected when the lines removed hold
more than `most_lost` of its word bytes or fewer than `least_words` words stay.
Independently, base rules on the whole text (too few words, too many repeated
8-word windows) reject it.

Defined results: a null or empty text has no words, so its counts are 0 and the
base rules reject it; repeated rows are judged one by one; other columns of the
input are not read.  One pass over the rows, no shuffle, bounded batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

# Fixed values.
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"')]}…’”»。！？"
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "privacy policy", "terms of service",
    "terms of use", "click here", "sign up for", "log in to", "subscribe to our", "lorem ipsum", "read more", "share this",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen",
    "hier klicken", "jetzt anmelden", "newsletter abonnieren", "javascript aktivieren", "weiterlesen", "mehr erfahren",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation",
    "mentions légales", "cliquez ici", "inscrivez-vous", "activer javascript", "lire la suite", "en savoir plus",
    "todos los derechos reservados", "aceptar cookies", "política de cookies", "política de privacidad",
    "términos de uso", "aviso legal", "haga clic aquí", "suscríbete a", "activar javascript", "leer más",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of the words of a line, or of the bytes in words of a text."""

    most_symbols: float = 0.3
    most_shouted: float = 0.5
    fragment_words: int = 3
    most_separators: float = 0.2
    most_stuttered: float = 0.5
    stutter_words: int = 8
    most_lost: float = 0.3
    least_words: int = 10
    base_words: int = 20
    base_repeated: int = 30
    window: int = 8


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_removed_lines long, n_kept_words long, lost double, kept boolean"


def _per_line(flags: np.ndarray, edges: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[edges]


def _phrases(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of boilerplate phrases, their A-Z in any case."""
    low = data.tobytes().lower()
    found = []
    for phrase in BOILERPLATE:
        needle, at = phrase.encode(), -1
        while (at := low.find(needle, at + 1)) >= 0:
            found.append((at, at + len(needle)))
    return found


def judge(column: pa.Array, rules: LineRules, with_text: bool) -> dict[str, object]:
    texts = W.texts_of(column)
    words = W.words_of(texts)
    data, n = texts.data, len(texts)
    space = W.SPACE[data]
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    out: dict[str, object] = {
        "n_words": words.per_text,
        "word_chars": texts.boundaries(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.boundaries(symbol),
    }

    # Lines: from the start of a text or after a newline to the next newline or the end of the text.
    newline = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate([texts.offsets[:-1], newline + 1]))
    text_of = np.concatenate([np.arange(n), np.searchsorted(texts.offsets, newline, "right") - 1])
    order = np.argsort(np.concatenate([texts.offsets[:-1] * 2, (newline + 1) * 2 - 1]), kind="stable")
    text_of = text_of[order]
    edges = np.concatenate([texts.offsets[:-1], newline + 1])[order]
    ends = np.concatenate([edges[1:], [len(data)]]) if len(edges) else edges
    ends = np.where(np.isin(ends - 1, newline) & (ends > edges), ends - 1, ends) if len(edges) else ends
    first = np.searchsorted(words.starts, edges)
    count = np.searchsorted(words.starts, ends) - first
    real = np.flatnonzero(count > 0)
    edges, ends, text_of, first, count = edges[real], ends[real], text_of[real], first[real], count[real]

    keys = W.spans_hash(data.astype(W.U), edges, ends, W.BYTE_BASE) ^ W.mix(text_of.astype(W.U))
    distinct = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(text_of, minlength=n) - np.bincount(text_of[distinct], minlength=n)

    at, windows = words.windows(rules.window)
    owner = words.text_of()
    twice = at[W.repeated(windows ^ W.mix(owner[at].astype(W.U)))]
    out["n_repeat_words"] = np.bincount(owner[W.covered(len(words.starts), twice, rules.window)], minlength=n) if len(twice) else np.zeros(n, np.int64)
    out["base_failed"] = (words.per_text < rules.base_words) | (100 * out["n_repeat_words"] > rules.base_repeated * words.per_text)

    # The rules.
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    symbols = _per_line(symbol & (data != ord("|")), edges, ends)
    bars = _per_line(data == ord("|"), edges, ends)
    marks = _per_line(data == ord("!"), edges, ends)
    small, capital = _per_line(lower, edges, ends), _per_line(upper, edges, ends)
    closed = np.zeros(len(edges), bool)
    until = words.ends[first + count - 1]
    for mark in CLOSING:
        raw = np.frombuffer(mark.encode(), np.uint8)
        fits = np.flatnonzero(until - edges >= len(raw))
        closed[fits[(data[until[fits, None] - len(raw) + np.arange(len(raw))] == raw).all(axis=1)]] = True
    failed = symbols > rules.most_symbols * count
    failed |= (marks > rules.most_shouted * count) & (capital > small)
    failed |= (count <= rules.fragment_words) & ~closed
    failed |= (bars > rules.most_separators * count) & (bars > 1)
    stutter = np.zeros(len(words.starts), bool)
    stutter[1:] = words.hashes[1:] == words.hashes[:-1]
    stuttered = _per_line(stutter, first + 1, first + count)
    failed |= (count >= rules.stutter_words) & (stuttered > rules.most_stuttered * count)
    if len(edges) and (hits := _phrases(data)):
        begin, end = np.array(hits).T
        line = np.searchsorted(edges, begin, "right") - 1
        failed[line[(line >= 0) & (end <= ends[line])]] = True  # not across lines or texts

    inside = _per_line(~space, edges, ends)
    total, gone = np.bincount(text_of, inside, n), np.bincount(text_of, inside * failed, n)
    lost = gone / np.maximum(total, 1)
    stay = np.bincount(text_of, count * ~failed, n).astype(np.int64)
    out |= {"n_lines": np.bincount(text_of, minlength=n), "n_removed_lines": np.bincount(text_of, failed, n).astype(np.int64), "n_kept_words": stay, "lost": lost}
    out["kept"] = ~out["base_failed"] & (lost <= rules.most_lost) & (stay >= rules.least_words)
    if with_text:
        lines: list[list[str]] = [[] for _ in range(n)]
        for i in np.flatnonzero(~failed):
            lines[text_of[i]].append(data[edges[i] : ends[i]].tobytes().decode("utf-8", "replace"))
        out["cleaned_text"] = ["\n".join(x) for x in lines]
    return out


def line_first_clean(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per input row: its id as ``doc_id``, counts, verdict ``kept`` and, if asked for, ``cleaned_text``."""
    own = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {SCHEMA}" + (", cleaned_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in judge(part.column("text"), rules, with_text).items()})

    return own.mapInArrow(run, schema)
