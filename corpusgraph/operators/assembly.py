"""What goes into an answer: phrases of a query, lines of evidence, direct facts, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def phrases(words: Column, longest: int = 3) -> Column:
    """Distinct runs of one to `longest` words."""
    runs = [
        F.when(F.size(words) >= n, _runs(words, n)).otherwise(F.array().cast("array<string>"))
        for n in range(1, longest + 1)
    ]
    return F.array_distinct(F.concat(*runs))


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def evidence_lines(chunks: DataFrame, key: str, text: str, terms: list[str], most: int = 8) -> DataFrame:
    """(key, line, score, text): per chunk the lines that hold most query terms (20 each) or look like headings (10), in order of score."""
    lines = chunks.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("at", "raw")).where(F.trim("raw") != "")
    score = sum((F.when(F.lower("raw").contains(t), 20).otherwise(0) for t in terms), F.when(F.col("raw").rlike(r"^ {0,3}(#{1,6} +|- |\* |[0-9]+\. )"), 10).otherwise(0))
    scored = lines.select(key, (F.col("at") + 1).alias("line"), score.alias("score"), T.one_line(F.col("raw"), 220).alias("text")).where("score > 0")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "line"))
    return scored.withColumn("place", place).where(F.col("place") <= most).drop("place")


def facts(chunks: DataFrame, key: str, text: str, keyword: str, pattern: str, most: int = 100) -> DataFrame:
    """(key, fact): distinct first groups of a pattern in texts that hold a keyword, `most` of a text at most."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return chunks.where(F.lower(text).contains(keyword.lower())).select(key, F.explode(F.slice(found, 1, most)).alias("fact"))


def suggest(pages: DataFrame, key: str, weighted: dict[str, float], terms: list[str], k: int) -> DataFrame:
    """(key, score): weight of each column for each term that is one of its tokens, 0.35 of it if tokens contain each other."""
    score = F.lit(0.0)
    for column, weight in weighted.items():
        words = T.tokens(F.coalesce(F.col(column), F.lit("")))
        for term in terms:
            part = _partial(words, term)
            score = score + F.when(F.array_contains(words, term), weight).when(part, weight * 0.35).otherwise(0.0)
    return pages.select(key, F.round(score, 3).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def _partial(words: Column, term: str) -> Column:
    if len(term) < 4:
        return F.lit(False)
    return F.exists(words, lambda w: (F.length(w) >= 4) & (w.contains(term) | F.contains(F.lit(term), w)))


def evidence_record(measured: DataFrame, name: str, least: int) -> DataFrame:
    """One JSON document: `measured` with its figures, or `insufficient_evidence` below `least` samples."""
    body = F.struct(F.lit(name).alias("metric"), F.when(F.col("n") >= least, "measured").otherwise("insufficient_evidence").alias("status"), F.when(F.col("n") >= least, F.col("value")).alias("value"), F.col("n").alias("samples"))
    return measured.select(F.to_json(body).alias("json"))
