"""Stemming by M. F. Porter's published rules ("An algorithm for suffix stripping", 1980), as a vectorised function over token lists."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rules' suffixes and what replaces them, steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last of them not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, and those with other signs than a to z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem_all(tokens: Column) -> Column:
    """Stems of an array of lower-case words, in order; null stays null."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(tokens)
