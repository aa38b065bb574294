"""Full-text: postings, document frequencies, BM25, staged matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
#: What FTS engines floor the inverse document frequency at.
IDF_FLOOR = 1e-6


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, doc_len). With `only` (terms) other terms are dropped before anything is dealt out.

    Term counts of a document are made within its row, so no exchange is needed to count them.
    """
    words = docs.select(F.col(key).alias("doc"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")).withColumn("doc_len", F.size("words").cast("long"))
    spread = words.select("doc", "doc_len", F.explode("words").alias("term"))
    if only is not None:
        spread = spread.join(F.broadcast(only.select("term").distinct()), "term")  # a query's terms
    return spread.groupBy("term", "doc", "doc_len").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: n documents and their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.coalesce(F.col(text), F.lit(""))))).alias("mean_len"))


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def bm25(posted: DataFrame, df: DataFrame, size: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score, matched) of the posted terms; the two small sides are a query's terms and one row."""
    x = posted.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # size has one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    if weights:
        part = part * F.coalesce(F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))[F.col("term")], F.lit(1.0))
    return x.groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def rarest(df: DataFrame, size: DataFrame, share: float = 0.15) -> DataFrame:
    """The rarest term that occurs, if it is in at most `share` of the documents."""
    return df.crossJoin(F.broadcast(size)).where((F.col("df") > 0) & (F.col("df") <= share * F.col("n"))).orderBy("df", "term").limit(1).select("term", "df")


def cascade(docs: DataFrame, key: str, text: str, phrase: list[str]) -> DataFrame:
    """(doc, stage): phrase, else all terms, else any. Only the first stage with a match is kept."""
    words = F.concat(F.lit(" "), F.array_join(T.tokens(F.coalesce(F.col(text), F.lit(""))), " "), F.lit(" "))
    has = [words.contains(f" {w} ") for w in phrase]
    every = has[0]
    for h in has[1:]:
        every = every & h
    stage = F.when(words.contains(f" {' '.join(phrase)} "), 1).when(every, 2).when(T.any_of(has), 3)
    found = docs.select(F.col(key).alias("doc"), stage.alias("stage")).where("stage is not null")
    first = found.agg(F.min("stage").alias("stage"))
    return found.join(F.broadcast(first), "stage").select("doc", "stage")


def top(scored: DataFrame, k: int, score: str = "score", key: str = "doc") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def ranked(scored: DataFrame, by: list, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return scored.withColumn(name, F.row_number().over(window.orderBy(*by)))
