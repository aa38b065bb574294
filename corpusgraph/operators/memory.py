"""Ranking of memories (documents with a lifecycle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Additions by class and factors by type.
CLASS_BOOST = {"rule": 0.08, "working": 0.06, "fact": 0.03, "episode": 0.01}
TYPE_BOOST = {"feedback": 1.3, "user": 1.0, "project": 1.0, "reference": 0.9, "wiki": 1.1}


def rank_score(rank: Column, recency: Column, accesses: Column, kind: Column, context: Column, type_boost: Column) -> Column:
    """0.6 / (60 + rank) + 0.15 recency; often used ones count half (over 15) or three quarters (over 8), others gain by use;
    then context and class are added, and the type multiplies."""
    base = 0.6 / (60 + rank) + 0.15 * recency
    used = F.when(accesses > 15, base * 0.5).when(accesses > 8, base * 0.75).otherwise(base + 0.25 * F.least(F.lit(1.0), accesses / 10) / 61)
    boost = F.lit(0.0)
    for name, value in CLASS_BOOST.items():
        boost = F.when(kind == name, value).otherwise(boost)
    return (used + context + boost) * type_boost


def type_boost(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, value in TYPE_BOOST.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def context_boost(paths: Column, files: list[str], text: Column, symbols: list[str]) -> Column:
    """0.08 for a path that is in use, 0.05 for a text that names a symbol."""
    any_ = lambda c, words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(c), F.lower(w))) if words else F.lit(False)
    return F.when(any_(paths, files), 0.08).otherwise(0.0) + F.when(any_(text, symbols), 0.05).otherwise(0.0)
