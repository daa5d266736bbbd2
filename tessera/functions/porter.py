"""The tokens of a full-text index: Unicode words without case and accents, reduced by Porter's algorithm of 1980."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")
_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]{1,32}")


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, rules: tuple, least: int) -> str:
    for end, new in sorted(rules, key=lambda x: -len(x[0])):
        if word.endswith(end):
            head = word[: -len(end)]
            return head + new if _measure(head) > least else word
    return word


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a folded word. Words of under three bytes or over 64 stay as they are."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if len(word) > 3 and word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if len(word) > 3 and word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, 0), _STEP3, 0)
    for end in _STEP4:
        if word.endswith(end):
            head = word[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e"):
        head, m = word[:-1], _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(head)):
            word = head
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@functools.lru_cache(maxsize=10_000)
def _unmarked(part: str) -> str:
    return "".join(c for c in part if unicodedata.category(c) != "Mn")


def fold(text: str) -> str:
    """Lower case without combining marks, which are looked for outside of ASCII only."""
    low = text.lower()
    return low if low.isascii() else _OTHER.sub(lambda found: _unmarked(found[0]), unicodedata.normalize("NFD", low))


def tokens(text: str | None) -> list[str]:
    return [stem(x) for x in _WORD.findall(fold(text or ""))]


@F.pandas_udf(ArrayType(StringType()))
def porter_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(tokens)


def plain_tokens(text):
    """Lower-case words of letters and numbers, in order: a column expression."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
