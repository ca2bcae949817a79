"""Chunking row by row."""

from pyspark.sql import functions as F

from lakeseek.functions import commonmark
from lakeseek.operators import chunking
from lakeseek.sources import files


def doc(i, text, kind="markdown"):
    return (i, "t", text, kind, "", "c", "", "")


def test_chunks_without_a_shuffle(spark):
    d = spark.createDataFrame([doc("a", "# One\n\n" + "word " * 40), doc("a", "# Two\n\n" + "other " * 40), doc("b", ""), doc("c", "short")], files.DOCUMENT)
    chunks = chunking.chunk_documents(chunking.normalize_documents(d))
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.title) for r in chunks.collect()) == [("a-chunk-0", "One"), ("a-chunk-0", "Two")]


def test_long_sections_go_by_windows(spark):
    words = [f"w{i}" for i in range(1_500)]
    d = spark.createDataFrame([doc("a", "# Head\n\n" + " ".join(words)), doc("e", "# Head\n\n" + " ".join(words[:1_100]))], files.DOCUMENT)
    got = {r.chunk_id: r.text.split() for r in chunking.chunk_documents(chunking.normalize_documents(d)).collect()}
    every = ["Head", *words]
    assert got == {f"a-chunk-{i}": every[540 * i : 540 * i + 600] for i in range(3)} | {"e-chunk-0": every[:1_101]}


def test_setext_headings_lists_and_links_in_chunks(spark):
    md = "First *head*\n===\n\n- see [the law](http://x.y/ \"t\") and `code`\n  - " + "nested " * 20 + "\n\nSecond\n---\n\n> " + "quoted " * 20
    got = [(r.title, r.text) for r in chunking.chunk_documents(spark.createDataFrame([doc("a", md)], files.DOCUMENT)).orderBy("position").collect()]
    assert got == [("First head", "First head see the law and code " + ("nested " * 20).strip()), ("Second", "Second " + ("quoted " * 20).strip())]


def test_markdown_text_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", chunking.to_text(F.col("text")).alias("m")).collect()
    assert rows and all(r.m == commonmark.text(r.text) for r in rows)
    words = lambda t: [w for w in (t or "").replace("*", " ").replace("#", " ").split() if w.isalpha()]
    assert all(len(words(r.m)) >= 0.9 * len(words(r.text)) for r in rows)
