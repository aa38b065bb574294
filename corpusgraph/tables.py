"""How the driver's tables stand for the engine's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: id, file_path (source/id.txt), language, name (source), content, size."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("lang").alias("language"), F.col("source").alias("name"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a call graph: src (supplier), dst (part), both in one id space, and how strongly."""
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("order"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of all call edges."""
    return call_edges(spark, sf_dir).select("src", "dst")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memories: id, class by role, access count by turn, fingerprint of the text."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "rule").when(F.col("role") == "user", "fact").otherwise("episode")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", kind.alias("class"), F.col("text").alias("content"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), (F.col("turn") * 3).alias("access_count"))
