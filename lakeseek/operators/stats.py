"""Ingestion statistics from an append-only log, and the index manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_log(chunks: DataFrame, event: str = "ingest") -> DataFrame:
    """(event, doc_id, corpus, chunks, embedded, failed, at): a row for each document."""
    count = lambda c: F.sum(F.col(c).cast("long")) if c in chunks.columns else F.lit(0).cast("long")
    has = F.sum(F.col("embedding").isNotNull().cast("long")) if "embedding" in chunks.columns else F.lit(0).cast("long")
    return chunks.groupBy("doc_id", "corpus").agg(F.count("*").alias("chunks"), has.alias("embedded"), count("embed_failed").alias("failed")).select(F.lit(event).alias("event"), "doc_id", "corpus", "chunks", "embedded", "failed", F.current_timestamp().alias("at"))


def sums(log: DataFrame, times: int = 1) -> DataFrame:
    """(corpus, documents, chunks, embedded, failures, last): what a part of the log adds for each corpus; times -1 takes it away again. Parts add up in any order and division."""
    sign = F.when(F.col("event") == "delete", -1).otherwise(1)
    named = log.withColumn("corpus", F.when(F.coalesce("corpus", F.lit("")) == "", "_default").otherwise(F.col("corpus")))
    at = F.col("at") if "at" in log.columns else F.lit(None).cast("timestamp")
    failed = F.col("failed") if "failed" in log.columns else F.lit(0)
    came = F.col("event") != "delete"
    count = lambda c, name: (F.sum(c) * times).cast("long").alias(name)
    return named.groupBy("corpus").agg(
        count(sign, "documents"), count(sign * F.col("chunks"), "chunks"), count(F.when(came, F.col("embedded")).otherwise(0), "embedded"), count(F.when(came, failed).otherwise(0), "failures"),
        F.max(F.when(came & at.isNotNull(), F.struct(at.alias("at"), "doc_id"))).alias("last"),
    )


def total(parts: DataFrame) -> DataFrame:
    """totals() of sums()."""
    out = parts.rollup("corpus").agg(
        *(F.greatest(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "chunks")), *(F.sum(c).cast("long").alias(c) for c in ("embedded", "failures")), F.max("last").alias("last")
    )
    return out.select("corpus", "documents", "chunks", "embedded", "failures", F.col("last.doc_id").cast("string").alias("last_document"), F.col("last.at").alias("last_at"))


def totals(log: DataFrame) -> DataFrame:
    """Documents, chunks, embedded chunks and failures in all (corpus null) and for each corpus, with the last document ingested and when; deletions count down, never below 0, and not for embedded and failures.

    Of documents of one time the largest id is the last, numbers as numbers. A log without times or failures
    has nulls and none.
    """
    return total(sums(log))


def chunking_stats(chunks: DataFrame) -> DataFrame:
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum(words).alias("token_count"), F.avg(words).alias("chunk_size_avg"))


def manifest_warnings(stored: dict, running: dict) -> list[str]:
    """What differs between the manifest that an index was built with and the running settings."""
    return [f"{k}: index has {stored.get(k)!r}, running {v!r}" for k, v in running.items() if k in stored and stored[k] != v]
