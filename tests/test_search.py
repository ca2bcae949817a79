"""Generated passages, rewrites and answers: batches, failures, time-outs, and a second pass for weak queries."""

import time

import pytest

from lakeseek.jobs.engine import NOTHING, Engine
from lakeseek.operators import generation, retrieve
from pyspark.sql import functions as F

DOCS = "id string, title string, content string, content_type string, original_content string, corpus string, book_title string, article string"
QUERIES = "qid string, text string, corpus string, hyde string, rewrite string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    def embed(texts):
        """Counts of letters."""
        return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    bodies = {
        "d1": "# Mesures\n\nLe président prend des mesures exigées par les circonstances, après consultation du conseil et des assemblées de la nation.",
        "d2": "# Scrutin\n\nLe scrutin pour le mandat présidentiel a lieu vingt jours au moins et trente-cinq jours au plus avant son expiration.",
        "d3": "# Zones\n\nZigzag zones zeppelin zebra zoo zen zest zinc zip zodiac zoom zeal zero zany zombie zeta zephyr zenith zillion zones.",
    }
    at = Engine(spark, str(tmp_path_factory.mktemp("store")), embed)
    at.ingest(spark.createDataFrame([(k, k, v, "markdown", "", "legal-demo" if k != "d3" else "web", "", "") for k, v in bodies.items()], DOCS))
    return at


def asked(spark, *rows):
    return spark.createDataFrame(rows, QUERIES)


def test_generator_in_batches(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"p{i}") for i in range(9)], "i int, p string").coalesce(1)

    def batches(prompts):
        return [f"{len(prompts)} {s}{p}" for s, p in prompts]

    got = {r.i: (r.generated, r.generated_failed) for r in generation.generate(rows, batches, F.col("p"), F.lit("s"), batch=4).collect()}
    assert got[0] == ("4 sp0", False) and got[8] == ("3 sp8", False) and got[3] == got[4] == (None, False)


def test_generator_that_fails_loses_no_row(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "i int, p string").coalesce(1)

    def bad(prompts):
        if prompts[0][1] == "p0":
            raise OSError("down")
        if prompts[0][1] == "p1":
            time.sleep(60)
        return [] if prompts[0][1] == "p2" else ["  "]

    began = time.time()
    got = {r.i: (r.generated, r.generated_failed) for r in generation.generate(rows, bad, F.col("p"), batch=1, seconds=1).collect()}
    assert got == {0: (None, True), 1: (None, True), 2: (None, True), 3: (None, False)} and time.time() - began < 40


def test_modes():
    assert [generation.mode(x) for x in ("true", " AUTO ", "0", None, "x")] == ["on", "auto", "off", "off", "off"]
    assert retrieve.wants_hyde(0.9, True) and retrieve.wants_hyde(0.5) and not retrieve.wants_hyde(0.9) and not retrieve.wants_hyde(0.0)


def test_rewrites_may_be_asked_for(spark):
    rows = spark.createDataFrame([("yes", ""), ("no", "legal"), (None, "My-Legal"), ("", "web"), ("?", None)], "rewrite string, corpus string")
    assert [r.w for r in rows.select(generation.wants_rewrites(F.col("rewrite"), F.col("corpus")).alias("w")).collect()] == [True, False, True, False, False]


def test_second_pass_for_weak_queries_only(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def passage(prompts):
        seen.add(len(prompts))
        return ["zzz zz zzzz" for _ in prompts]

    q = asked(spark, ("weak", "mesures", "", "on", ""), ("strong", "scrutin", "", "off", ""), ("auto", "scrutin", "", "auto", ""))
    plain = {(r.qid, r.rank): r.chunk_id for r in store.retrieve(q.select("qid", "text", "corpus")).collect()}
    got = store.retrieve(q, generate=passage).collect()
    assert seen.value == 1
    by = {(r.qid, r.rank): r for r in got}
    assert {k: r.chunk_id for k, r in by.items() if k[0] != "weak"} == {k: c for k, c in plain.items() if k[0] != "weak"}
    assert {r.doc_id for r in got if r.qid == "weak"} == {"d1", "d2", "d3"} and by["weak", 1].score < 0.04  # ranks, fused


def test_failing_generator_loses_no_query(spark, store):
    def broken(prompts):
        raise OSError("down")

    q = asked(spark, ("a", "mesures du président", "legal-demo", "on", "on"), ("b", "zebra", "", "on", ""))
    got = {r.qid for r in store.retrieve(q, generate=broken).collect()}
    assert got == {"a", "b"}
    assert {(r.qid, r.status) for r in store.search(q, broken).collect()} == {("a", "failed"), ("b", "failed")}


def test_search_answers_and_says_what_it_searched_for(spark, store):
    def model(prompts):
        return [f"answer {p.count('[1]')}" if s else "Requête 1 : scrutin mandat\nRequête 2: SCRUTIN MANDAT\nabc" for s, p in prompts]

    q = asked(spark, ("a", "rôle du président", "legal-demo", "off", None), ("b", "xyzzy", "", "off", ""), ("c", "rôle du président", "legal-demo", "off", "no"))
    got = {r.qid: r for r in store.search(q, model, retrieve.RetrieveParams(min_score=0.0)).collect()}
    assert got["a"].status == "ok" and got["a"].answer == "answer 1" and got["a"].rewrite_queries.startswith("rôle du président | ") and got["a"].rewrite_queries.endswith(" | scrutin mandat")
    assert "scrutin mandat" not in got["c"].rewrite_queries and len(got) == 3


def test_search_without_hits(spark, store, tmp_path):
    bare = Engine(spark, str(tmp_path))  # words only
    bare.ingest(spark.createDataFrame([("d", "d", "# T\n\n" + "mots " * 40, "markdown", "", "web", "", "")], DOCS))
    got = bare.search(asked(spark, ("b", "xyzzy", "", "on", "")), lambda prompts: ["never"] * len(prompts)).collect()
    assert [(r.status, r.message, r.answer, r.rewrite_queries) for r in got] == [("no_results", NOTHING, None, "xyzzy")]
    with pytest.raises(ValueError):
        bare.search(asked(spark, ("b", " ", "", "on", "")), lambda p: p)


def test_parameters_as_texts():
    of = retrieve.RetrieveParams.of
    assert of({}) == of({"top_k": "x", "bm25_k": "-1", "min_score": "nan", "fusion": "7", "vector_k": None, "legal_rerank": "?", "other": "1"}) == retrieve.RetrieveParams()
    got = of({"top_k": " 3 ", "fusion": "0.25", "min_score": "0", "doc_id": " d ", "legal_rerank": "No", "max_per_doc": "2", "article": "16"})
    assert got == retrieve.RetrieveParams(top_k=3, weight=0.25, min_score=0.0, doc_id="d", legal_rerank=False, max_per_doc=2, article="16")
    assert of({"fusion": "RRF"}).fusion == "rrf"
