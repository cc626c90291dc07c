"""Retrieval quality and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_metrics(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """queries, hit_at_3, hit_at_5, mrr of `ranked` (query, domain, rank) against `labels` (query, expected domain).
    A query without any match counts as 0."""
    first = ranked.join(labels, "query").filter("domain = expected OR endswith(domain, concat('.', expected))").groupBy("query").agg(F.min("rank").alias("rank"))
    rows = labels.select("query").distinct().join(first, "query", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0)).alias("hit_at_3"), F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("hit_at_5"), F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def engine_coverage(rows: DataFrame) -> DataFrame:
    """source, queries, results, domains."""
    return rows.groupBy("source").agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("results"), F.countDistinct("domain").alias("domains"))


def channel_counts(rows: DataFrame, channel: str) -> DataFrame:
    return rows.groupBy(channel).agg(F.count(F.lit(1)).alias("n"))
