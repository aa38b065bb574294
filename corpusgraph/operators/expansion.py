"""What is added to a ranked list, or changes its scores: recency, callers and callees, siblings, name matches, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..steps import tasks

#: Discounts (fixed values) of what comes in by the graph and as a sibling; most that name matches multiply a score by.
GRAPH_DISCOUNT, SIBLING_DISCOUNT = 0.6, 0.4
#: Rows of a block of a large group, and pairs of a task (fixed values).
BLOCK, TASK_PAIRS = 500, 5_000_000


def recency_boost(score: Column, at: Column, now: Column, weight: float) -> Column:
    """The score and `weight` for what is new, less as it ages, nothing after 90 days; without a date the score stays."""
    return score + F.coalesce(weight * T.recency(at, now), F.lit(0.0))


def by_graph(ranked: DataFrame, edges: DataFrame, top: int = 10, each: int = 5) -> DataFrame:
    """(id, score): the ranked list, and of its first `top` up to `each` callers and callees at 0.6 of the best score that
    brings them. `edges` is (src, dst); the first by id are taken. The list's head is small, so it is what is sent around."""
    head = F.broadcast(ranked.orderBy(F.desc("score"), "id").limit(top))  # `top` rows
    near = []
    for own, other in (("src", "dst"), ("dst", "src")):
        found = edges.join(head, edges[own] == head["id"]).select(F.col("id").alias("seed"), "score", F.col(other).alias("id")).distinct()
        near.append(found.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("n") <= each).select("id", (F.col("score") * GRAPH_DISCOUNT).alias("score")))
    more = near[0].union(near[1]).groupBy("id").agg(F.max("score").alias("score")).join(ranked, "id", "left_anti")
    return ranked.select("id", "score").union(more)


def by_parent(ranked: DataFrame, rows: DataFrame, top: int = 5, each: int = 5) -> DataFrame:
    """(id, score): the ranked list, and of its first `top` up to `each` others of the same parent at 0.4 of their score.
    `rows` is (id, parent); the `each` and `top` first of a parent are enough, so groups are cut before they meet."""
    head = ranked.orderBy(F.desc("score"), "id").limit(top).join(rows, "id").where("parent is not null").select(F.col("id").alias("seed"), "score", "parent")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("id"))).where(F.col("n") <= each + 1).select("id", "parent")
    found = first.join(F.broadcast(head), "parent").where("id <> seed").withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("n") <= each)  # `top` rows
    more = found.groupBy("id").agg(F.max(F.col("score") * SIBLING_DISCOUNT).alias("score")).join(ranked, "id", "left_anti")
    return ranked.select("id", "score").union(more)


def pairs_within(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(key, other): every ordered pair of different keys of a group. Pairs are what grows, so groups are cut into blocks of
    some `BLOCK` rows, each two of which meet in a cell, and cells dealt out to tasks of some `TASK_PAIRS` pairs."""
    held = rows.select(key, *by).dropna(subset=by)
    sizes = held.groupBy(*by).agg(F.count("*").alias("n"))
    most = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    crowded = sizes.where(F.col("n") > BLOCK).select(*by, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = held.join(F.broadcast(crowded), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))  # a BLOCK-th of the rows at most
    own, each = F.pmod(F.xxhash64(key), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    one = placed.select(key, *by, own.alias("x"), each.alias("y"))
    two = placed.select(F.col(key).alias("other"), *by, each.alias("x"), own.alias("y"))
    cell, n = [*by, "x", "y"], tasks(most, TASK_PAIRS)
    return one.repartition(n, *cell).join(two.repartition(n, *cell).hint("shuffle_hash"), cell).where(F.col(key) != F.col("other")).select(key, "other")


def without_tests(ranked: DataFrame, path: str, mode: str = "penalty", factor: float = 0.3) -> DataFrame:
    """Test files go (`exclude`) or count less (`penalty`)."""
    test = T.is_test_path(F.col(path))
    return ranked.where(~test) if mode == "exclude" else ranked.withColumn("score", F.when(test, F.col("score") * factor).otherwise(F.col("score")))


def weighted_bm25(rows: DataFrame, key: str, fields: dict[str, float], terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score, matched) of rows with a term: BM25 in which a field's hits count by its weight.

    Tokens become counts inside the row, so nothing is exploded, and one aggregate gives all that terms need.
    """
    words = {f: T.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    held = rows.select(key, *(w.alias(f"w_{f}") for f, w in words.items()))
    count = lambda f, t: F.size(F.filter(f"w_{f}", lambda w: w == t))
    counted = held.select(key, sum(F.size(f"w_{f}") for f in fields).alias("n"), *(sum(x * count(f, t) for f, x in fields.items()).alias(f"tf_{k}") for k, t in enumerate(terms)))
    facts = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(terms))))

    def part(k: int) -> Column:
        rare = F.greatest(F.log((F.col("docs") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5)), F.lit(1e-6))
        return F.when(F.col(f"tf_{k}") > 0, rare * F.col(f"tf_{k}") * (k1 + 1) / (F.col(f"tf_{k}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))).otherwise(0.0)

    matched = sum((F.col(f"tf_{k}") > 0).cast("int") for k in range(len(terms)))
    scored = counted.crossJoin(F.broadcast(facts)).select(key, sum(part(k) for k in range(len(terms))).alias("score"), matched.alias("matched"))  # one row
    return scored.where("matched > 0")
