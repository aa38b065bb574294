"""Retrieval quality, latencies, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded_metrics(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """Per query of (query, rank, grade, n_relevant): DCG@k, nDCG@k, MRR, AP, P@k, R@k. Ideal order is by grade."""
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), "rank"))
    hits = F.sum((F.col("grade") > 0).cast("int")).over(Window.partitionBy(query).orderBy("rank"))
    x = ranked.withColumn("ideal", ideal).withColumn("hits", hits)
    top = F.col("rank") <= k
    relevant = F.col("grade") > 0
    out = x.groupBy(query).agg(
        F.sum(F.when(top, gain("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain("ideal")).otherwise(0.0)).alias("idcg"),
        F.coalesce(F.max(F.when(relevant, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(relevant, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precision_sum"),
        F.count_if(top & relevant).alias("found"),
        F.max("n_relevant").alias("n_relevant"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(query, F.round("dcg", 6).alias("dcg"), F.round(share("dcg", "idcg"), 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), F.round(share("precision_sum", "n_relevant"), 6).alias("ap"), F.round(F.col("found") / k, 6).alias("p_at_k"), F.round(share("found", "n_relevant"), 6).alias("r_at_k"))


def nearest_rank(value: Column, share: float) -> Column:
    """The value at place ceil(share n): an element, never between two."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value._jc.toString()})")


def latency_summary(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, mean, p50 at index floor(n / 2), p95 at index min(floor(0.95 n), n - 1) of the sorted values (from 0)."""
    window = Window.partitionBy(*key)
    x = samples.withColumn("at", F.row_number().over(window.orderBy(value)) - 1).withColumn("n", F.count("*").over(window))
    pick = lambda at: F.max(F.when(F.col("at") == at, F.col(value)))
    return x.groupBy(*key).agg(F.max("n").alias("n"), F.round(F.avg(value), 6).alias("mean"), pick(F.floor(F.col("n") * 0.5)).alias("p50"), pick(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95"))


def majority_style(styles: DataFrame, key: list[str], style: str) -> DataFrame:
    """The naming style with 60 % of the classified names, else `mixed`."""
    n = lambda s: F.count_if(F.col(style) == s)
    x = styles.groupBy(*key).agg(n("camelCase").alias("camel"), n("snake_case").alias("snake"), n("PascalCase").alias("pascal"))
    total = F.col("camel") + F.col("snake") + F.col("pascal")
    best = F.when(total == 0, "mixed").when(F.col("camel") / total >= 0.6, "camelCase").when(F.col("snake") / total >= 0.6, "snake_case").when(F.col("pascal") / total >= 0.6, "PascalCase").otherwise("mixed")
    return x.select(*key, "camel", "snake", "pascal", best.alias("style"))


def coverage(trees: DataFrame, most: int) -> DataFrame:
    """With utilization, balance and overall of trees with `up` and `down` nodes besides the seed, `most` nodes at most."""
    total = F.col("up") + F.col("down")
    use = (F.least(total + 1, F.lit(most)) - 1) / (most - 1) if most > 1 else F.lit(0.0)
    balance = F.when(total > 0, 1 - F.abs(F.col("up") - F.col("down")) / total).otherwise(0.0)
    return trees.withColumns({"utilization": F.round(use, 3), "balance": F.round(balance, 3), "overall": F.round(0.7 * use + 0.3 * balance, 3)})
