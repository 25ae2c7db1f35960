"""Stems of English words, by the published definition of the Porter2 algorithm; words with Cyrillic letters stay as they
are, as no public definition of a Ukrainian stemmer was at hand. Parts of a token between other characters are stemmed
apart."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words with stems of their own, and words that stay.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
STAY_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Starts after which the first region begins.
STARTS = ("gener", "commun", "arsen")
#: Endings of the second and third step and what they become.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousness": "ous", "ousli": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWEL = "aeiouy"
SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region(word: str, start: int) -> int:
    m = re.search(r"[aeiouy][^aeiouy]", word[start:])
    return start + m.end() if m else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def english(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) < 3 or word in STAY:
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    first = next((len(s) for s in STARTS if w.startswith(s)), None) or _region(w, 0)
    second = _region(w, first)
    w = w.removesuffix("'s'").removesuffix("'s").removesuffix("'")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in STAY_AFTER_PLURAL:
        return w
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= first:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif first >= len(w) and SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    end = _longest(w, SECOND)
    if end and len(w) - len(end) >= first:
        rest = w[: -len(end)]
        if end == "li":
            w = rest if rest[-1:] in tuple("cdeghkmnrt") else w
        elif end != "ogi" or rest.endswith("l"):
            w = rest + SECOND[end]
    end = _longest(w, THIRD)
    if end and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + THIRD[end]
    end = _longest(w, FOURTH)
    if end and len(w) - len(end) >= second and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) > second or len(w) > first and not SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(token: str) -> str:
    """Each run of letters and digits stemmed on its own; what stands between stays."""
    return re.sub(r"[^\W_]+", lambda m: m[0] if re.search("[Ѐ-ӿ]", m[0]) else english(m[0]), token)


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of each distinct word, for joins."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else stem(w) for w in batch.column(0).to_pylist()], pa.string())], [word, "stem"])

    return words.select(F.col(word).cast("string")).distinct().mapInArrow(run, f"`{word}` string, stem string")


@F.arrow_udf(ArrayType(StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Stems of the words of a short field."""
    return pa.array([None if w is None else [stem(x) for x in w] for w in words.to_pylist()], pa.list_(pa.string()))


def shares_stem(words: Column, token: str) -> Column:
    """Whether a whole word has the token's stem."""
    return F.array_contains(stem_words(words), stem(token))
