"""Document and gold-case sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

DOCUMENT = "id string, title string, content string, content_type string, original_content string, corpus string, book_title string, article string"
GOLD = (
    "id string, corpus string, retrieval_q string, generation_q string, expected_chunk_ids array<string>, expected_doc_ids array<string>, expected_sections array<string>, match_all_sections boolean, "
    "excerpt_terms_by_section map<string,array<string>>, generation_phrases array<string>, reference_answer string, expect_no_results boolean"
)


def _from_files(files: DataFrame, root: str, corpus: str) -> DataFrame:
    rel = F.ltrim(F.substring_index(F.col("path"), root.rstrip("/"), -1), F.lit("/"))
    rows = files.select(rel.alias("rel"), F.decode("content", "UTF-8").alias("content")).withColumn("content_type", X.content_type(F.col("rel")))
    rows = rows.where("content_type IS NOT NULL")
    return rows.select(X.stable_doc_id(F.col("rel")).alias("id"), X.title_from_path(F.col("rel")).alias("title"), "content", "content_type", F.lit("").alias("original_content"), F.lit(corpus).alias("corpus"), F.lit("").alias("book_title"), F.lit("").alias("article"))


#: Names of the files that are read; others are not opened.
NAMES = "*.{" + ",".join(e for x in ("md", "markdown", "html", "htm") for e in (x, x.upper(), x.capitalize())) + "}"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", NAMES).load(root)


def read_directory(spark: SparkSession, root: str, corpus: str = "") -> DataFrame:
    """A document for each .md, .markdown, .html or .htm file below root; others are not read."""
    return _from_files(_files(spark, root).select("path", "content"), root, corpus)


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, doc_id, length, modified) of the files that read_directory() reads, without their content."""
    rel = F.ltrim(F.substring_index(F.col("path"), root.rstrip("/"), -1), F.lit("/"))
    return _files(spark, root).select("path", X.stable_doc_id(rel).alias("doc_id"), "length", F.col("modificationTime").alias("modified"))


def read_changed(spark: SparkSession, root: str, corpus: str, known: DataFrame) -> DataFrame:
    """read_directory() of the files that known, an earlier snapshot, hasn't got with that length and time. Only these are opened."""
    now = snapshot(spark, root)
    changed = now.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti").select("path")
    few = changed.limit(CHANGED + 1).collect()
    if len(few) > CHANGED:  # many: all are read, and those that stayed are left out
        return _from_files(_files(spark, root).join(changed, "path", "left_semi").select("path", "content"), root, corpus)
    if not few:
        return spark.createDataFrame([], DOCUMENT)
    paths = [r["path"] for r in few]
    return _from_files(spark.read.format("binaryFile").load(paths).select("path", "content"), root, corpus)


#: Changed files up to which they are read by their paths.
CHANGED = 10_000


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; malformed lines are left out, absent fields are empty."""
    rows = spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases of JSON lines; blank and # lines are skipped. A case needs a query: raise_if_invalid() checks."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    return lines.select(F.from_json("v", GOLD).alias("c")).select("c.*")


def invalid_gold(gold: DataFrame) -> DataFrame:
    return gold.where("coalesce(retrieval_q, '') = '' AND coalesce(generation_q, '') = ''")
