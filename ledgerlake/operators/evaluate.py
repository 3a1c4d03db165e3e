"""How well a ranking finds what it should."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_ranks(ranked: DataFrame, accepted: DataFrame, queries: DataFrame) -> DataFrame:
    """query and the best rank of its accepted documents, null if none is ranked."""
    hits = ranked.join(accepted, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return queries.select("query").distinct().join(hits, "query", "left")


def recall_mrr(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: number of queries, recall at each depth and mean reciprocal rank, six decimals; all null or 0 without queries."""
    hit = lambda k: F.round(F.avg(F.when(F.coalesce(F.col("rank"), F.lit(k + 1)) <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return ranks.agg(F.count("*").alias("queries"), *map(hit, at), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def outcomes_by_type(judged: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row per question type with the number of cases of each outcome."""
    return judged.groupBy("type").pivot("outcome", outcomes).count().na.fill(0)
