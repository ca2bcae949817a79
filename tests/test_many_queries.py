"""Many queries at once: what is moved is k rows a query and task, or linear in the corpus, never queries times chunks."""

import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import terms as T
from lakeseek.jobs.engine import Engine
from lakeseek.operators import excerpt, index, legal, lexical, stats
from lakeseek.session import app_dir

CHUNKS = "chunk_id string, doc_id string, corpus string, title string, doc_title string, section_path string, position int, article string, text string"
QUERIES = "qid string, text string, corpus string"


def rows_of(n=240, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(f"c{i}", f"d{i // 2}", rng.choice(["a", "b"]), rng.choice(["", "common w7"]), "doc w9", "path", i, "", " ".join(["common"] * rng.randrange(1, 4) + rng.choices(words, k=8))) for i in range(n)]


def by_hand(rows, queries, k, combine):
    docs, df, tokens = {}, Counter(), 0
    for c, _, corpus, title, doc_title, path, _, _, text in rows:
        fields = {"text": text.split(), "title": title.split(), "doc_title": doc_title.split(), "section": (title or path).split()}
        docs[c] = corpus, fields
        df.update({t for ts in fields.values() for t in ts})
        tokens += sum(map(len, fields.values()))
    n, mean, out = len(docs), tokens / len(docs), []
    for q, text, want in queries:
        scored = []
        for c, (corpus, fields) in docs.items():
            if want in ("", corpus):
                idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in text.split()}
                parts = [T.BOOSTS[f] * sum(idf[t] * ts.count(t) * (T.K1 + 1) / (ts.count(t) + T.K1 * (1 - T.B + T.B * len(ts) / mean)) for t in text.split()) for f, ts in fields.items()]
                scored.append((-round(max(parts) if combine == "max" else sum(parts), 9), c))
        out += [(q, i + 1, c, round(-s, 6)) for i, (s, c) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("combine", "prune"), [("max", False), ("max", True), ("sum", False), ("sum", True)])
def test_hits_equal_counts_by_hand_however_the_work_is_dealt(spark, tmp_path, monkeypatch, combine, prune):
    for name, value in {"AT_ONCE": 100, "ASKED": 4, "DEALT": 300, "LEAST": 50, "BROADCAST_ROWS": 30, "TERMS": 20}.items():
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(index, "BLOCK", 8)
    rows, rng = rows_of(), random.Random(4)
    asked = [(f"q{i}", " ".join(["common", f"w{rng.randrange(60)}", f"w{rng.randrange(60)}", "common"][i % 2 :]), ["", "a", "b"][i % 3]) for i in range(14)]
    at = index.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "index"))
    got = lexical.search(at, spark.createDataFrame(asked, QUERIES), 5, combine, prune=prune).collect()
    assert sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 6)) for r in got) == by_hand(rows, asked, 5, combine)


def test_pairs_of_queries_and_chunks_are_not_moved(spark, tmp_path):
    at = index.build(spark.createDataFrame(rows_of(), CHUNKS), str(tmp_path / "index"))
    found = lexical.search(at, spark.createDataFrame([("q", "common w3", "")], QUERIES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+, chunk_id", plan)


def test_articles_are_added_where_the_chunks_are(spark, monkeypatch):
    """The same rows where nothing is broadcast; pairs of queries and chunks meet no hits by a shuffle."""
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", "ab"[i % 2], "", "", "p", 0, str(i % 5), "x") for i in range(40)], CHUNKS)
    hits = spark.createDataFrame([("q1", "c1", 2.0), ("q1", "c6", 1.0), ("q2", "c2", 3.0), ("q4", "c1", 1.0)], "qid string, chunk_id string, score double")
    asked = spark.createDataFrame([("q1", "article 1 et article 2", ""), ("q2", "article 2, article 3", "a"), ("q3", "article 4 article 1", "b"), ("q4", "article 1", "")], QUERIES)
    want = {("q1", "c1", 2.0), ("q1", "c6", 1.0), ("q2", "c2", 3.0), ("q4", "c1", 1.0)}
    want |= {("q1", f"c{i}", 1.9) for i in range(40) if i % 5 in (1, 2) and i not in (1, 6)}
    want |= {("q2", f"c{i}", 2.85) for i in range(0, 40, 2) if i % 5 in (2, 3) and i != 2} | {("q3", f"c{i}", 1.0) for i in range(1, 40, 2) if i % 5 in (4, 1)}
    for most in (lexical.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", most)
        got = legal.boost_articles(hits, asked, chunks)
        rows = got.collect()
        assert {(r.qid, r.chunk_id, round(r.score, 6)) for r in rows} == want and len(rows) == len(want)
        assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_last_of_numbered_documents_goes_by_number(spark):
    log = spark.createDataFrame([(9999, 5), (10999, 5), (500, 3)], "doc_id long, s long")
    log = log.select(F.lit("ingest").alias("event"), "doc_id", F.lit("x").alias("corpus"), F.lit(1).alias("chunks"), F.lit(0).alias("embedded"), F.timestamp_seconds("s").alias("at"))
    assert {r.last_document for r in stats.totals(log).collect()} == {"10999"}


def test_a_commit_is_written_once(spark, tmp_path):
    """Documents, chunks and postings go to the commit's folder, not to the shared one first; a commit's rows are those of its documents."""
    base = Path(app_dir(spark).removeprefix("file:"))
    before = set(base.iterdir()) if base.exists() else set()
    schema = "id string, title string, content string, content_type string, original_content string, corpus string, book_title string, article string"
    text = "# H\n\n" + " ".join(f"word{i}" for i in range(40))
    store = Engine(spark, str(tmp_path))
    for ids in (range(6), range(4, 9)):
        store.ingest(spark.createDataFrame([(str(i), "t", text, "markdown", "", "web", "", "") for i in ids], schema))
    made = {p.name.rsplit("-", 1)[0] for p in set(base.iterdir() if base.exists() else ()) - before}
    assert not made & {"documents", "chunks", "postings"}
    assert sorted(r.doc_id for r in store.documents().collect()) == [str(i) for i in range(9)]
    assert store.index().postings.where("term = 'word3'").select("doc_id").distinct().count() == 9


def test_sentences_are_asked_only_for_terms_that_the_text_has(spark):
    """Scores equal counts by hand, and a text without any of many terms costs no look a sentence."""
    text = "Alpha beta. beta, gamma beta! Delta. " * 300
    few, many = ["beta", "delta"], ["beta", "delta", *(f"absent{i}" for i in range(400))]
    d = spark.createDataFrame([(text,)], "text string")
    took = {}
    for name, terms in (("few", few), ("many", many)) * 2:
        began = time.perf_counter()
        rows = d.select(F.explode(excerpt.scored_sentences(F.col("text"), F.array(*map(F.lit, terms))))).select("col.*").collect()
        took[name] = time.perf_counter() - began
        assert [r.score for r in rows[:3]] == [1, 3, 1] and len(rows) == 600
    assert took["many"] < 4 * took["few"] + 2
