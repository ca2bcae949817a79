"""Evaluation of retrieval, excerpts and answers against gold cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X


def per_case(hits: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """(id, hit, rr, retrieved, expect_no_results).

    A case is hit by the first of its k results whose chunk or document is expected;
    by sections, any of them or (match_all_sections) all, at the best rank. A refusal
    is hit if nothing comes back, and has reciprocal rank 0.
    """
    g = gold.select(
        "id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("expected_chunk_ids", "expected_doc_ids", "expected_sections")),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("match_all_sections", "expect_no_results")),
    )
    rows = g.join(hits.where(F.col("rank") <= k).withColumnRenamed("qid", "id"), "id", "left")
    by_id = F.array_contains("expected_chunk_ids", F.col("chunk_id")) | F.array_contains("expected_doc_ids", F.col("doc_id"))
    want = F.filter("expected_sections", lambda w: X.section_matches(F.col("section"), F.col("article"), w))
    rows = rows.withColumn("__want", F.when(F.col("chunk_id").isNotNull(), want)).withColumn("__r", F.when(F.coalesce(by_id, F.lit(False)) | (F.size("__want") > 0), F.col("rank")))
    got = rows.groupBy("id").agg(
        F.min("__r").alias("r"), F.count("chunk_id").alias("retrieved"), F.size(F.array_distinct(F.flatten(F.collect_list("__want")))).alias("found"),
        F.first(F.size("expected_sections")).alias("n"), F.first("match_all_sections").alias("all"), F.first("expect_no_results").alias("expect_no_results"),
    )
    ok = F.col("r").isNotNull() & (~F.col("all") | (F.col("found") == F.col("n")))
    hit = F.when(F.col("expect_no_results"), F.col("retrieved") == 0).otherwise(ok)
    return got.select("id", hit.alias("hit"), F.when(hit & ~F.col("expect_no_results"), 1.0 / F.col("r")).otherwise(0.0).alias("rr"), "retrieved", "expect_no_results")


def report(cases: DataFrame) -> DataFrame:
    """One row: cases, recall_at_k (refusals that hold count), mrr over all cases, refusal_accuracy."""
    ok = F.col("hit").cast("int")
    return cases.agg(F.count("*").alias("cases"), F.avg(ok).alias("recall_at_k"), F.avg("rr").alias("mrr"), F.avg(F.when(F.col("expect_no_results"), ok)).alias("refusal_accuracy"))


def gate(report: DataFrame, least: float) -> tuple[bool, float]:
    """Whether a report's recall reaches the least, and that recall; no cases don't. A least of 0 or less always holds."""
    recall = report.first()["recall_at_k"] or 0.0
    return least <= 0 or recall >= least, recall


def excerpt_cases(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, section, passed): the excerpt of the first hit in a section holds every term asked for there."""
    asked = gold.where("excerpt_terms_by_section IS NOT NULL").select("id", F.explode("excerpt_terms_by_section").alias("want", "terms"))
    rows = asked.join(hits.withColumnRenamed("qid", "id"), "id", "left")
    match = X.section_matches(F.coalesce("section", F.lit("")), F.coalesce("article", F.lit("")), F.col("want"))
    first = rows.groupBy("id", "want", "terms").agg(F.min_by(F.when(match, F.col("excerpt")), F.when(match, F.col("rank"))).alias("excerpt"))
    low = F.lower(F.coalesce("excerpt", F.lit("")))
    return first.select("id", F.col("want").alias("section"), F.forall("terms", lambda t: F.contains(low, F.lower(t))).alias("passed"))


def phrase_cases(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, passed): the answer holds every phrase."""
    rows = gold.where("size(generation_phrases) > 0").join(answers, "id", "left")
    low = F.lower(F.coalesce("answer", F.lit("")))
    return rows.select("id", F.forall("generation_phrases", lambda p: F.contains(low, F.lower(p))).alias("passed"))


def refusals(answers: DataFrame) -> DataFrame:
    """answers with refusal: whether the answer says that the excerpts don't tell."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    return answers.withColumn("refusal", F.exists(F.array(*map(F.lit, T.REFUSALS)), lambda p: F.contains(low, p)))


def write_report(report: DataFrame, cases: DataFrame, path: str) -> None:
    """One JSON object below path: the report's columns and per_case, sorted by id. Cases are as many as someone wrote down."""
    each = cases.agg(F.array_sort(F.collect_list(F.struct("id", "hit", "rr", "retrieved", "expect_no_results"))).alias("per_case"))
    report.join(F.broadcast(each)).coalesce(1).write.mode("overwrite").json(path)
