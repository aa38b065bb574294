"""Porter's stemmer, by its published rules, and a hashing embedder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: Endings of steps 2, 3 and 4 of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (e := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (e := _longest(w, rules)) and measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + rules[e]
    if (e := _longest(w, STEP4)) and measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms, in Arrow batches: stem the vocabulary, not every occurrence, and join."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"term": words, "stem": [w and stem(w) for w in words]})

    return terms.select("term").distinct().mapInArrow(run, "term string, stem string")


def hashed_embedding(words: Column, parts: int = 64) -> Column:
    """A unit vector by the hashing trick: each word adds 1 or -1 to one place; no words give zeros."""
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(parts))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    signed = F.transform(words, lambda w: F.struct(place(w).alias("p"), sign(w).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.aggregate(signed, F.lit(0.0), lambda t, x: t + F.when(x["p"] == i, x["s"]).otherwise(0.0)))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda t, x: t + x * x))
    return F.when(length > 0, F.transform(raw, lambda x: x / length)).otherwise(raw)
