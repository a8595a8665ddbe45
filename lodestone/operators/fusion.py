"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(ranked: DataFrame, k: int, score: str = "score") -> DataFrame:
    """``(chunk_id, score)`` with 1 / (60 + rank) of the ``k`` best rows, rank 1 the best; equal scores by the smaller id.

    The cut is made by a heap per task, so the ranking sees ``k`` rows.
    """
    order = (F.round(score, 9).desc(), F.col("chunk_id"))
    best = ranked.select("chunk_id", score).orderBy(*order).limit(k)
    return best.select("chunk_id", (1.0 / (RRF_K + F.row_number().over(Window.orderBy(*order)))).alias("score"))


def fused(semantic: DataFrame, keyword: DataFrame, alpha: float) -> DataFrame:
    """``alpha * semantic + (1 - alpha) * keyword`` over the union of both lists, 0 where one lacks a chunk."""
    a = semantic.select("chunk_id", F.col("score").alias("s"))
    b = keyword.select("chunk_id", F.col("score").alias("k"))
    zero = F.lit(0.0)
    return a.join(b, "chunk_id", "full").select("chunk_id", (F.lit(alpha) * F.coalesce("s", zero) + F.lit(1 - alpha) * F.coalesce("k", zero)).alias("score"))
