"""The Porter stemmer (M. F. Porter, 1980) with the author's later changes to steps 2, over a vocabulary.

Rules are data: each step is a list of endings with what replaces them and a condition on
the stem that is left.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The endings of the published algorithm.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_STEP_2, _STEP_3 = (sorted(step, key=lambda p: -len(p[0])) for step in (STEP_2, STEP_3))
_STEP_4 = sorted(STEP_4, key=len, reverse=True)


def _shape(word: str) -> str:
    """c and v for each character; y is a vowel after a consonant, and all but a, e, i, o, u and such y are consonants."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _shape(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word):
                        word = word if word[-1] in "lsz" else word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP_2, _STEP_3):
        for end, to in rules:
            if word.endswith(end):
                word = word[: -len(end)] + to if _measure(word[: -len(end)]) else word
                break
    for end in _STEP_4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(words: DataFrame) -> DataFrame:
    """(word, stem) for the distinct words of ``words(word)``: Python sees each word once."""
    return words.select("word").distinct().select("word", stem_udf("word").alias("stem"))


class _Stems(dict):
    """Stems of the words met so far, at most a million; of a word that is its own stem, nothing."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 1_000_000:
            self.clear()
        found = stem(word)
        self[word] = found = "" if found == word else found
        return found


_STEMS = _Stems()


@F.pandas_udf(StringType())
def _stems_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join([_STEMS[w] for w in t.split(" ")]), na_action="ignore")


def stems_of(words: Column) -> Column:
    """The stem of each word of an array of words without spaces, empty where it is the word itself."""
    return F.when(F.size(words) > 0, F.split(_stems_udf(F.array_join(words, " ")), " ")).otherwise(F.slice(words, 1, 0))
