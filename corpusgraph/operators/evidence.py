"""Evidence of an assembled context: confidence, strength, pruning, corroboration, rollups of candidates, dominant families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_pattern

#: Files that a mode keeps (fixed values); other modes keep all.
FILES = {"trace": 5, "bug": 8, "architecture": 6, "change": 6}
#: What the source of a selection counts (fixed values).
SOURCES = {"direct_match": 28, "flow_chunk": 28, "workflow_bundle": 28, "inventory_bundle": 28, "mandatory_flow_step": 46, "wiki_capability": 48, "trace_seed": 18, "trace_hint": 6}


def evidence_confidence(mode: Column, delivery: Column, chunks: Column, files: Column, surfaces: Column, family: Column) -> Column:
    """How well files and surfaces support an answer, three places, at most the family's confidence if there is one."""
    deep = F.least(F.lit(0.92), 0.78 + F.least(F.lit(3), files - 3) * 0.04 + F.when(surfaces >= 2, 0.02).otherwise(0.0))
    wide = F.least(F.lit(0.92), 0.78 + F.least(F.lit(3), files - 4) * 0.035 + F.least(F.lit(2), surfaces - 2) * 0.02)
    own = (
        F.when(mode == "lookup", F.when(files >= 1, 0.9).otherwise(0.0))
        .when(mode.isin("trace", "bug"), F.when(files <= 1, 0.62).when(files == 2, 0.72).otherwise(deep))
        .when(mode.isin("architecture", "change"), F.when(files <= 2, 0.62).when((files == 3) | (surfaces < 2), 0.72).otherwise(wide))
        .otherwise(0.0)
    )
    return F.when(F.coalesce(chunks, F.lit(0)) == 0, 0.0).when(delivery == "summary_only", 0.35).otherwise(F.round(F.least(own, family), 3))


def context_strength(mode: Column, delivery: Column, chunks: Column, files: Column, selected: Column, confidence: Column) -> Column:
    """sufficient, partial or weak."""
    broad = mode.isin("architecture", "change") & (confidence >= 0.75) & (files >= 4)
    return (
        F.when((F.coalesce(chunks, F.lit(0)) == 0) | (F.coalesce(delivery, F.lit("")) == "summary_only"), "weak")
        .when(mode == "lookup", F.when(selected >= 1, "sufficient").otherwise("partial"))
        .when(mode.isin("trace", "bug"), F.when(confidence >= 0.75, "sufficient").otherwise("partial"))
        .when(broad, "sufficient")
        .otherwise(F.when(selected > 0, "partial").otherwise("weak"))
    )


def file_score(matches: Column, order: Column, source: Column, noise: Column) -> Column:
    """24 a matching term, 18 less 2 a place in the context (null: not in it), the source's worth, 100 less for noise."""
    worth = F.create_map(*(x for k, v in SOURCES.items() for x in (F.lit(k), F.lit(v))))
    return 24 * matches + F.coalesce(F.greatest(F.lit(0), 18 - 2 * order), F.lit(0)) + F.coalesce(F.element_at(worth, source), F.lit(0)) - F.when(noise, 100).otherwise(0)


def prune_files(files: DataFrame, key: str) -> DataFrame:
    """Of each query's selected files (key, mode, score, order) the best that its mode keeps, ties by place in the context."""
    limit = F.create_map(*(x for k, v in FILES.items() for x in (F.lit(k), F.lit(v))))
    ranked = files.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.coalesce("order", F.lit(999)))))
    return ranked.where(F.col("place") <= F.coalesce(F.element_at(limit, F.col("mode")), F.lit((1 << 31) - 1))).drop("place")


def corroboration(candidates: DataFrame, family: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, n): how many family files are a candidate itself, import it or are imported by it. `imports` is (src, dst);
    a family has a dozen files at most, which the caller sees to, so it is what is sent around."""
    near = imports.select(F.col("src").alias("file"), F.col("dst").alias("other")).union(imports.select("dst", "src"))
    met = near.join(F.broadcast(family.select(F.col("file").alias("other"))), "other").select("file", "other").union(family.select("file", F.col("file").alias("other")))
    counted = met.distinct().groupBy("file").agg(F.count("*").alias("n"))
    return candidates.select("file").join(counted, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"))


def file_rollup(chunks: DataFrame) -> DataFrame:
    """A row a file of broad candidates: most anchors, all layers and families (labels of a fixed set), whether every
    chunk is utility or any is noise."""
    return chunks.groupBy("file").agg(F.max("anchors").alias("anchors"), F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(F.collect_set("family")).alias("families"), F.bool_and("utility").alias("utility"), F.bool_or("noise").alias("noise"), F.max("score").alias("score"))


#: Families that a query names itself, in this order.
NAMED = (
    ("billing", ["billing", "checkout", "portal", "subscription", "invoice", "payment", "credit"]),
    ("generation", ["generate", "generation", "regenerate", "regeneration", "render", "image generation"]),
    ("storage", ["upload", "storage", "bucket", "object store", "media write"]),
    ("auth", ["auth", "authentication", "login", "signin", "signup", "session", "oauth"]),
    ("routing", ["routing", "router", "route protection", "protected route", "redirect", "navigation"]),
)


def named_family(query: Column) -> Column:
    """The first family that a query names; null if it names none. It goes before dominant_family()."""
    low = F.lower(query)
    return F.coalesce(*(F.when(low.rlike(word_pattern(words)), family) for family, words in NAMED))


def dominant_family(terms: DataFrame, candidates: DataFrame, key: str, workflow: Column, first: int = 12) -> DataFrame:
    """(key, family): by weights of query terms (key, family, weight) and 0.15 of the scores of the first twelve
    candidates (key, place, family, layer, score, utility, noise), `logging` counting 0.72 beside others; for workflows 0.55
    for each backend candidate. Ties go to the first family by name."""
    c = candidates.where(F.col("place") <= first)
    backing = ((F.col("layer") == "backend") & ~F.col("utility") & ~F.col("noise")).cast("int")
    votes = terms.select(key, "family", "weight", F.lit(0).alias("backing")).union(c.select(key, "family", F.col("score") * 0.15, backing)).where("family is not null")
    summed = votes.groupBy(key, "family").agg(F.sum("weight").alias("score"), F.sum("backing").alias("backing"))
    alone = F.count("*").over(Window.partitionBy(key)) == 1  # families are a fixed set
    score = F.round(F.col("score") * F.when((F.col("family") == "logging") & ~alone, 0.72).otherwise(1.0) + F.when(workflow, F.col("backing") * 0.55).otherwise(0.0), 9)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("adjusted"), "family"))
    return summed.withColumn("adjusted", score).withColumn("place", place).where("place = 1").select(key, "family")
