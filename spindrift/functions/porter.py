"""The Porter stemmer (M. F. Porter, 1980), as a pandas UDF over arrays of tokens with a memo of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm: suffix, replacement, by step.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    shape = _shape(word)
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:], strict=False))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # 1a
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif word.endswith("ed"):
        cut = word[:-2]
    elif word.endswith("ing"):
        cut = word[:-3]
    if cut is not None and "v" in _shape(cut):
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double_end(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        found = max(((s, r) for s, r in table if word.endswith(s)), key=lambda x: len(x[0]), default=None)
        if found and _measure(word[: -len(found[0])]):
            word = word[: -len(found[0])] + found[1]
    found = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if found and _measure(base := word[: -len(found)]) > 1 and (found != "ion" or base[-1:] in ("s", "t")):
        word = base
    # 5
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda words: None if words is None else [stem(w) for w in words])
