"""Fusion of ranked lists, caps and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T


def weighted(bm25: DataFrame, vector: DataFrame, w: float = 0.6) -> DataFrame:
    """w * bm25 / best bm25 + (1 - w) * cosine / best cosine; what a list lacks is 0, as is a list whose best is not positive."""
    both = bm25.select("qid", "chunk_id", F.col("score").alias("b")).join(vector.select("qid", "chunk_id", F.col("score").alias("v")), ["qid", "chunk_id"], "full")
    both = both.select("qid", "chunk_id", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("v", F.lit(0.0)).alias("v"))
    q = Window.partitionBy("qid")
    part = lambda c: F.when(F.max(c).over(q) > 0, F.col(c) / F.max(c).over(q)).otherwise(0.0)
    return both.select("qid", "chunk_id", (w * part("b") + (1 - w) * part("v")).alias("score"))


def rrf(*lists: DataFrame, k: int = T.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over lists of (qid, chunk_id, rank)."""
    rows = lists[0].select("qid", "chunk_id", "rank")
    for x in lists[1:]:
        rows = rows.union(x.select("qid", "chunk_id", "rank"))
    return rows.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def multi_query_rrf(hits: DataFrame, k: int = T.RRF_K) -> DataFrame:
    """(qid, variant, chunk_id, rank) -> (qid, chunk_id, score) over all variants of a query."""
    return hits.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def length_penalty(score: Column, text: Column, full: int = 80) -> Column:
    return score * F.least(F.lit(1.0), F.length(F.trim(text)) / F.lit(float(full)))


def cap_per_doc(hits: DataFrame, most: int | Column, by: str = "qid") -> DataFrame:
    """At most so many hits of a document, best first; 0 or less is no cap."""
    most = F.lit(most) if isinstance(most, int) else most
    w = Window.partitionBy(by, "doc_id").orderBy(F.round("score", 9).desc(), F.col("chunk_id").asc())
    return hits.withColumn("__n", F.row_number().over(w)).where((most <= 0) | (F.col("__n") <= most)).drop("__n")


def dedupe_queries(queries: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """Queries distinct but for case and outer space, the first of each; blank ones go."""
    w = Window.partitionBy(by, F.lower(F.trim(text))).orderBy(order)
    rows = queries.where(F.trim(text) != "")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
