"""Two rankings of the same documents fused, with metadata filters and a fallback.

Queries are rows: one question and a batch go through the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_id
from ..scratch import durable_table
from ..tables import union_all

#: Constant of the fusion, depth of each ranking, and hits below which a filter is given up.
RRF_K, DEPTH, FEW = 5, 100, 3


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query, doc, score (twelve decimals) and `fused_rank` of rankings (query, doc, rank): the sum of 1 / (k + rank); ties by id."""
    together = union_all(*(r.select("query", "doc", "rank") for r in rankings))
    summed = together.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"))
    return summed.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rrf_score").desc(), "doc")))


def trace(vector: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """The fusion of two rankings with the rank that each gave, null where it doesn't hold the document."""
    both = vector.select("query", "doc", F.col("rank").alias("vector_rank")).join(lexical.select("query", "doc", F.col("rank").alias("bm25_rank")), ["query", "doc"], "full_outer")
    score = F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0))
    scored = both.withColumn("rrf_score", F.round(score, 12))
    return scored.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rrf_score").desc(), "doc")))


def search_with_fallback(rank: Callable[[DataFrame, bool], list[DataFrame]], queries: DataFrame, few: int = FEW) -> list[DataFrame]:
    """The rankings of all queries: a query with a filter whose narrow rankings have fewer than `few` hits together is ranked again without it, a query without one is ranked widely.

    queries: query, `filtered` (whether it has a filter) and whatever `rank(queries, narrow)` needs; the narrow rankings are kept while hits are counted, so only the queries given up are ranked again.
    """
    narrow = [durable_table(r.select("query", "doc", "rank"), "narrow") for r in rank(queries.where("filtered"), True)]
    hits = union_all(*(r.select("query") for r in narrow)).groupBy("query").agg(F.count("*").alias("_n"))
    counted = queries.join(hits, "query", "left").where(~F.col("filtered") | (F.coalesce("_n", F.lit(0)) < few)).drop("_n")
    widely = durable_table(counted, "widely")
    wide = rank(widely, False)
    return [union_all(a.join(widely.select("query"), "query", "left_anti"), b.select("query", "doc", "rank")) for a, b in zip(narrow, wide, strict=True)]


def with_fallback(filtered: list[DataFrame], unfiltered: list[DataFrame], queries: DataFrame, few: int = FEW) -> list[DataFrame]:
    """For each query the filtered rankings, or all unfiltered ones if the filtered have fewer than `few` hits together and a filter was set.

    queries: query and `filtered` (whether it has a filter).
    """
    hits = union_all(*(r.select("query") for r in filtered))
    counted = queries.join(hits.groupBy("query").agg(F.count("*").alias("_n")), "query", "left")
    given_up = counted.select("query", (F.col("filtered") & (F.coalesce("_n", F.lit(0)) < few)).alias("_up"))
    return [union_all(a.join(given_up.where("not _up"), "query", "left_semi"), b.join(given_up.where("_up"), "query", "left_semi")) for a, b in zip(filtered, unfiltered, strict=True)]


def best_of_base(fused: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k first documents of each query after parts are traced back to the chunk they were split from.

    `known` has the ids (`doc`) of whole chunks. Unknown bases are dropped; part and whole keep their own scores, the first counts.
    """
    ids = known.select(F.col("doc").alias("_known")).distinct()
    direct = fused.join(ids, F.col("doc") == F.col("_known"), "left")
    based = direct.withColumn("base", F.when(F.col("_known").isNotNull(), F.col("doc")).otherwise(base_id(F.col("doc")))).drop("_known")
    there = based.join(ids, F.col("base") == F.col("_known"), "left_semi").repartition("query")  # both windows lie within a query
    first = Window.partitionBy("query", "base").orderBy("fused_rank")
    once = there.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query").orderBy("fused_rank")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
