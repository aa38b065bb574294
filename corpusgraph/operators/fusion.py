"""Rank fusion, score adjustments, diversity, and the token-budget fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(first: DataFrame, second: DataFrame, key: str, weights: tuple[float, float], k: float = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) over two ranked lists (key, rank); a k that isn't positive counts as 60."""
    k = k if 0 < k < float("inf") else RRF_K
    a, b = first.select(key, F.col("rank").alias("rank_a")), second.select(key, F.col("rank").alias("rank_b"))
    score = F.coalesce(weights[0] / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(weights[1] / (k + F.col("rank_b")), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, "rank_a", "rank_b", score.alias("score"))


def length_penalty(score: Column, lines: Column) -> Column:
    return F.when(lines > 80, score * (80 / (lines * 0.8 + 16))).otherwise(score)


def attribute_boost(score: Column, active: Column, code: Column, test: Column, anonymous: Column) -> Column:
    """Open files x 1.5, code x 1.5, tests x 0.3, unnamed chunks x 0.5."""
    for condition, factor in ((active, 1.5), (code, 1.5), (test, 0.3), (anonymous, 0.5)):
        score = F.when(condition, score * factor).otherwise(score)
    return score


def score_floor(scored: DataFrame, partition: list[str], ratio: float, score: str = "score") -> DataFrame:
    """Rows that reach a share of their group's best score. The best comes by aggregation and a join, not in one window."""
    best = scored.groupBy(*partition).agg(F.max(score).alias("__best")) if partition else scored.agg(F.max(score).alias("__best"))
    joined = scored.join(best, partition) if partition else scored.crossJoin(F.broadcast(best))  # one row
    return joined.where(F.col(score) >= ratio * F.col("__best")).drop("__best")


def merge_variants(results: DataFrame, key: str) -> DataFrame:
    """Results (variant, key, rank, score) of several phrasings of a query: variant q weighs max(0.55, 1 - 0.15 q), scores
    count as a share of their variant's best, places add 0.2 / rank, and each further appearance 0.18."""
    best = results.groupBy("variant").agg(F.max("score").alias("best"))
    weight = F.greatest(F.lit(0.55), 1 - 0.15 * F.col("variant"))
    part = weight * (F.col("score") / F.col("best") + 0.2 / F.col("rank"))
    merged = results.join(F.broadcast(best), "variant").groupBy(key).agg(F.sum(part).alias("total"), F.count("*").alias("appearances"))  # a row a variant
    return merged.select(key, (F.col("total") + 0.18 * (F.col("appearances") - 1)).alias("score"), "appearances")


def diversify(scored: DataFrame, group: str, key: str, score: str = "score") -> DataFrame:
    """The best of each group first, then the others, each by score."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return scored.withColumn("later", (within > 1).cast("int"))


def within_budget(ordered: DataFrame, query: str, order: list[str], key: str, cost: str, budget: int) -> DataFrame:
    """(query, key, spent): items in order that still fit; one too large is passed over and later ones are tried.

    A fold over each query's candidates, which a ranking has already bounded.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("__key"), F.col(cost).cast("long").alias("__cost"))))
    empty = F.struct(F.lit(0).cast("long").alias("spent"), F.expr("cast(array() as array<struct<k:bigint,s:bigint>>)").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        after = acc["spent"] + x["__cost"]
        fits = after <= budget
        one = F.array(F.struct(x["__key"].cast("long").alias("k"), after.alias("s")))
        return F.struct(F.when(fits, after).otherwise(acc["spent"]).alias("spent"), F.when(fits, F.concat(acc["taken"], one)).otherwise(acc["taken"]).alias("taken"))

    folded = ordered.groupBy(query).agg(F.aggregate(items, empty, take)["taken"].alias("taken"))
    return folded.select(query, F.explode("taken").alias("t")).select(query, F.col("t.k").alias(key), F.col("t.s").alias("spent"))
