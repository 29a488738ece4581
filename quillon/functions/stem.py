"""Snowball stemmers (published Porter2 and Spanish algorithms) and stemming of whole texts.

Only distinct tokens go through Python: texts are tokenised in Spark, each
(token, language) is stemmed once, and the stems are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import filter_stop_words, tokenize

# Fixed values of the published English algorithm.
EN_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
EN_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate",
    "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "anci": "ance", "abli": "able", "alli": "al", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
EN_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, vowels: str, start: int) -> int:
    """Start of what follows the first non-vowel after a vowel, from start."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def stem_en(word: str) -> str:
    """Porter2."""
    word = word.lower().replace("’", "'").strip()
    if len(word.encode()) <= 2:
        return word
    if word in EN_SPECIAL:
        return EN_SPECIAL[word]
    if word in EN_SAME:
        return word
    word = word.removeprefix("'")
    word = re.sub("(^|(?<=[aeiouy]))y", "Y", word)
    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else _region(word, "aeiouy", 0)
    r2 = _region(word, "aeiouy", r1)
    word = re.sub("('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif re.search("(ied|ies)$", word):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif re.search("[aeiouy].*[^us]s$", word) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in EN_AFTER_1A:
        return word.lower()
    # 1b
    if found := re.search("(eedly|eed)$", word):
        if found.start() >= r1:
            word = word[: found.start()] + "ee"
    elif (found := re.search("(ingly|edly|ing|ed)$", word)) and re.search("[aeiouy]", word[: found.start()]):
        word = word[: found.start()]
        if re.search("(at|bl|iz)$", word):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    # 1c
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)
    # 2, 3, 4: the longest ending counts, in its region or not.
    for ending in sorted(EN_STEP2, key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1 and (ending != "ogi" or word[:at].endswith("l")) and (ending != "li" or re.search("[cdeghkmnrt]$", word[:at])):
                word = word[:at] + EN_STEP2[ending]
            break
    for ending in sorted(EN_STEP3, key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1 and (ending != "ative" or at >= r2):
                word = word[:at] + EN_STEP3[ending]
            break
    for ending in EN_STEP4:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or re.search("[st]$", word[:at])):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# Fixed values of the published Spanish algorithm.
ES_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
ES_1_R2 = "anzas anza icos icas ico ica ismos ismo ables able ibles ible istas ista osos osas oso osa amientos amiento imientos imiento".split()
ES_1_IC = "adoras adores aciones adora ador ación antes ancias ante ancia".split()
ES_2A = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
ES_2B_EN = "en es éis emos".split()
ES_2B = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos
    erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an
    aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis
    abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")
_ES = "aeiouáéíóúü"


def _longest(word: str, endings: list[str], start: int = 0) -> str | None:
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)


def stem_es(word: str) -> str:
    """Snowball Spanish."""
    word = word.lower()
    if len(word.encode()) <= 2:
        return word
    r1 = _region(word, _ES, 0)
    r2 = _region(word, _ES, r1)
    rv = len(word)
    if len(word) > 3:
        vowel = [c in _ES for c in word]
        if not vowel[1]:
            rv = next((i + 1 for i in range(2, len(word)) if vowel[i]), len(word))
        elif vowel[0] and vowel[1]:
            rv = next((i + 1 for i in range(2, len(word)) if not vowel[i]), len(word))
        else:
            rv = 3
    # 0: attached pronouns
    pronoun = _longest(word, ES_PRONOUNS)
    if pronoun and len(word) - len(pronoun) >= rv:
        head = word[: -len(pronoun)]
        if found := re.search("(iéndo|ándo|ár|ér|ír)$", head):
            if found.start() >= rv:
                word = head[: found.start()] + found.group().translate(_ACUTE)
        elif (found := re.search("(iendo|ando|ar|er|ir)$", head)) and found.start() >= rv or (found := re.search("uyendo$", head)) and found.start() + 1 >= rv:
            word = head
    before = word
    # 1: standard endings
    plain = {"logías": "log", "logía": "log", "uciones": "u", "ución": "u", "encias": "ente", "encia": "ente"}
    endings = [*ES_1_R2, *ES_1_IC, *plain, "amente", "mente", "idades", "idad", "ivas", "ivos", "iva", "ivo"]
    ending = _longest(word, endings)
    at = len(word) - len(ending or "")

    def drop(*more: str) -> str:
        """word, cut at the first of the endings that stands in R2."""
        for m in more:
            if word.endswith(m) and len(word) - len(m) >= r2:
                return word[: -len(m)]
        return word

    if ending == "amente" and at >= r1:
        word = word[:at]
        word = drop("ativ", "iv", "os", "ic", "ad")
    elif ending and at >= r2:
        word = word[:at] + plain.get(ending, "")
        if ending in ES_1_IC:
            word = drop("ic")
        elif ending == "mente":
            word = drop("ante", "able", "ible")
        elif ending in ("idades", "idad"):
            word = drop("abil", "ic", "iv")
        elif ending in ("ivas", "ivos", "iva", "ivo"):
            word = drop("at")
    # 2: verb endings, if nothing was done
    if word == before:
        ending = _longest(word, ES_2A, rv)
        if ending and word[: -len(ending)].endswith("u"):
            word = word[: -len(ending)]
        elif ending := _longest(word, ES_2B + ES_2B_EN, rv):
            word = word[: -len(ending)]
            if ending in ES_2B_EN and word.endswith("gu"):
                word = word[:-1]
    # 3: what is left
    ending = _longest(word, ["os", "a", "o", "á", "í", "ó"], rv)
    if ending:
        word = word[: -len(ending)]
    elif _longest(word, ["e", "é"], rv):
        word = word[:-1]
        if word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ACUTE)


STEMMERS: dict[str, Callable[[str], str]] = {"en": stem_en, "es": stem_es}


def register_stemmer(lang: str, stem: Callable[[str], str]) -> None:
    STEMMERS[lang] = stem


def stems_of(tokens: DataFrame) -> DataFrame:
    """token, lang, stem of distinct (token, lang) rows."""
    stemmers = dict(STEMMERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=[stemmers[lang](t) if lang in stemmers else t for t, lang in zip(batch.token, batch.lang, strict=True)])

    return tokens.select("token", "lang").distinct().mapInPandas(run, "token string, lang string, stem string")


def stem_texts(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """id, stemmed: tokens without stop words, stemmed, joined by spaces; of an unknown language, the tokens."""
    return stem_columns(docs.select("id", "lang", text_col), {"stemmed": text_col}).select("id", "stemmed")


def stem_columns(docs: DataFrame, columns: dict[str, str], most: int = 1 << 16, at_once: int = 256) -> DataFrame:
    """docs without a text column of the name, with new columns of stemmed texts: new name -> column of texts; docs has a lang.

    One pass in Arrow batches without a shuffle or a join.  A worker remembers the stems of `most` words at a time and
    handles `at_once` texts at a time, so that its memory grows neither with the input nor with the vocabulary.
    """
    stemmers = dict(STEMMERS)
    kept = [c for c in docs.columns if c not in columns]
    line = lambda c: F.array_join(filter_stop_words(tokenize(F.coalesce(F.col(c), F.lit(""))), F.col("lang")), " ")
    rows = docs.select(*kept, *[line(c).alias(name) for name, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, str]] = {}
        for whole in batches:
            for batch in (whole.slice(i, at_once) for i in range(0, len(whole), at_once)):
                langs, out = batch.column("lang").to_pylist(), {}
                for name in columns:
                    out[name] = []
                    for lang, text in zip(langs, batch.column(name), strict=True):
                        stem, text = stemmers.get(lang), text.as_py()
                        if stem is not None and text:
                            memory, stems = known.setdefault(lang, {}), []
                            for t in text.split(" "):
                                s = memory.get(t)
                                if s is None:
                                    if len(memory) >= most:
                                        memory.clear()
                                    s = memory[t] = stem(t)
                                stems.append(s)
                            text = " ".join(stems)
                        out[name].append(text)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.string()) if n in out else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
