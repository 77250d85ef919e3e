"""Rank fusion and reranking of a bounded head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, HEAD = 60, 20


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score): sum of 1 / (k + rank) over the lists that hold the document."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in ranked])
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def rerank_head(ranked: DataFrame, own_score: str, head: int = HEAD) -> DataFrame:
    """The first ``head`` by another scorer, the rest in their order behind them."""
    w = W.partitionBy("query_id").orderBy(F.when(F.col("rank") <= head, 0).otherwise(1), F.when(F.col("rank") <= head, F.col(own_score)).desc_nulls_last(), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w))
