"""English stemming by suffix rules, for the stemmed keyword lane.

The steps follow M. F. Porter, "An algorithm for suffix stripping" (1980), in the version without
later revisions: a word's measure m is the number of vowel-consonant runs before the suffix.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.retrieval import tokens

#: Words that carry no meaning of their own: a choice of this engine.
STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its no not of on or our she so such that the their then there these they this to was we were will with you your".split())

# Suffix, replacement; the stem before the suffix needs measure > 0.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
# Suffixes removed where the stem has measure > 1.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _closed(w: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


def _vowel(w: str) -> bool:
    return not all(_consonant(w, i) for i in range(len(w)))


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _closed(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    end = max((e for e in STEP_4 if w.endswith(e)), key=len, default="")
    base = w[: len(w) - len(end)]
    if end and _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
        w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _closed(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stems(column: pd.Series) -> pd.Series:
    return column.map(lambda words: None if words is None else [stem(w) for w in words if w not in STOP_WORDS])


def stems(text: Column) -> Column:
    """Stems of a text's tokens in order, without stop words."""
    return F.pandas_udf(_stems, T.ArrayType(T.StringType()))(tokens(text))


def stem_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, stems(F.col(text)))
