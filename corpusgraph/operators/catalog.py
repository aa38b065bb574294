"""Targets and their aliases: generation with weights, deduplication, resolution of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..steps import tasks

MOST_ALIASES = 24
#: Targets of a task (a fixed value).
TASK_TARGETS = 20_000


def dealt(targets: DataFrame, key: str) -> DataFrame:
    """Targets in tasks of some `TASK_TARGETS`; more targets are more tasks, not larger ones."""
    return targets.repartition(tasks(targets.count(), TASK_TARGETS), key)


def aliases(targets: DataFrame, key: str, name: str, weight: float) -> DataFrame:
    """(key, alias, normalized, weight): the name, its words joined in four ways at falling weights, its words, their stems.

    Of equal normalised forms the heaviest stays (longer, then first by alphabet on ties), and `MOST_ALIASES` a target.
    Targets are dealt out by key first, as `dealt()` does: their aliases, some ten times as many rows, are sorted where they are.
    """
    words = T.boundary_tokens(F.col(name))
    single = lambda alias, w: F.struct(alias.alias("alias"), F.lit(round(w, 4)).alias("weight"))
    tokens = F.filter(words, lambda w: F.length(w) >= 3)
    whole = F.array(single(F.col(name), weight), single(F.array_join(words, " "), weight), single(T.kebab(words), weight - 0.02), single(T.snake(words), weight - 0.03), single(T.camel(words), weight - 0.04))
    parts = F.transform(tokens, lambda w: single(w, max(0.45, weight - 0.2)))
    stems = F.transform(F.flatten(F.transform(tokens, T.morph_aliases)), lambda w: single(w, max(0.38, weight - 0.24)))
    spread = dealt(targets.select(key, name), key).select(key, F.explode(F.concat(whole, parts, stems)).alias("a")).select(key, "a.alias", F.array_join(T.boundary_tokens(F.col("a.alias")), " ").alias("normalized"), "a.weight").where(F.length("normalized") >= 2)
    best = Window.partitionBy(key, "normalized").orderBy(F.desc("weight"), F.desc(F.length("alias")), "alias")
    one = spread.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    rank = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(F.length("normalized")), "normalized")
    return one.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= MOST_ALIASES).drop("n")


def resolve(phrases: DataFrame, catalog: DataFrame, key: str, k: int) -> DataFrame:
    """(query, key, weight): for each query its best targets by the heaviest alias that one of its phrases equals."""
    hits = phrases.join(catalog, phrases["phrase"] == catalog["normalized"]).groupBy("query", key).agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), key))
    return hits.withColumn("n", rank).where(F.col("n") <= k).drop("n")
