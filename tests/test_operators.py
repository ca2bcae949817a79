import json

import pytest
from pyspark.sql import functions as F

from lakeseek.jobs.engine import Engine
from lakeseek.operators import chunking, evalkit, fusion, index, legal, lexical, retrieve, stats, vector
from lakeseek.sources import files
from lakeseek.streaming.ingest import ingest_stream

CHUNK = "chunk_id string, doc_id string, corpus string, title string, doc_title string, section_path string, position int, article string, text string"


def chunk(i, text, doc=None, corpus="", article="", title="", path="p", pos=0):
    return (i, doc or i, corpus, title, "", path, pos, article, text)


def test_windows_cover_every_word(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "doc_id long, text string")
    got = [r.text.split() for r in chunking.token_windows(docs, cfg=chunking.ChunkConfig(5, 2)).orderBy("position").collect()]
    assert got == [list("01234"), list("34567"), list("6789")]
    with pytest.raises(ValueError):
        chunking.ChunkConfig(5, 5)


def test_merge_small_matches_a_fold(spark):
    texts = ["a" * 10, "b" * 100, "c" * 5, "d" * 5, "e" * 90, "f" * 3]
    rows = spark.createDataFrame([("x", i, f"c{i}", "", t) for i, t in enumerate(texts)], "doc string, o int, chunk_id string, title string, text string")
    got = [(r.chunk_id, r.text) for r in chunking.merge_small(rows, "doc", "o").orderBy("position").collect()]
    assert got == [("c0", "a" * 10 + "\n\n" + "b" * 100), ("c2", "c" * 5 + "\n\n" + "d" * 5 + "\n\n" + "e" * 90), ("c5", "f" * 3)]


def test_bm25_ranks_and_corpus(spark):
    c = spark.createDataFrame([chunk("a", "natural selection of species and natural things", corpus="x"), chunk("b", "laws of motion and gravity", corpus="y")], CHUNK)
    at = index.build(c)
    q = spark.createDataFrame([("q", "natural selection", ""), ("r", "natural selection", "y"), ("s", "nothing", "")], "qid string, text string, corpus string")
    assert [(r.qid, r.chunk_id) for r in lexical.search(at, q).collect()] == [("q", "a")]


def test_vector_top_two_of_a_corpus(spark):
    v = spark.createDataFrame([("a", "legal", [1.0, 0.0, 0.0]), ("b", "legal", [0.9, 0.1, 0.0]), ("c", "other", [0.0, 1.0, 0.0]), ("d", "legal", [])], "chunk_id string, corpus string, embedding array<double>")
    q = spark.createDataFrame([("q", "legal", [1.0, 0.0, 0.0])], "qid string, corpus string, embedding array<double>")
    assert [r.chunk_id for r in vector.search(v, q, 2).orderBy("rank").collect()] == ["a", "b"]


def test_rrf_and_cap(spark):
    hits = spark.createDataFrame([("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1), ("q", 1, "c", 2)], "qid string, variant int, chunk_id string, rank int")
    got = lexical.top_k(fusion.multi_query_rrf(hits), 8).orderBy("rank").collect()
    assert len(got) == 3 and got[0].chunk_id == "b"
    rows = spark.createDataFrame([("q", "a", "a0", 1.0), ("q", "a", "a1", 0.9), ("q", "a", "a2", 0.8), ("q", "b", "b0", 0.7)], "qid string, doc_id string, chunk_id string, score double")
    assert sorted(r.chunk_id for r in fusion.cap_per_doc(rows, 2).collect()) == ["a0", "a1", "b0"]
    assert fusion.cap_per_doc(rows, 0).count() == 4


def test_dedupe_queries(spark):
    q = spark.createDataFrame([("q", i, t) for i, t in enumerate(["a", "A", "b", "a", " "])], "qid string, o int, text string")
    assert sorted(r.text for r in fusion.dedupe_queries(q, "qid", "text", "o").collect()) == ["a", "b"]


def test_legal_rerank(spark):
    rows = [("q", "election presidentielle report scrutin", "legal-demo", f"c{a}", a, "", "texte", "", s) for a, s in (("11", 0.9), ("16", 0.85), ("7", 0.8))]
    hits = spark.createDataFrame(rows, "qid string, query string, qcorpus string, chunk_id string, article string, title string, text string, section_path string, score double")
    got = [r.article for r in legal.rerank(hits).orderBy(F.desc("score")).collect()]
    assert got.index("7") < 2 and got.index("7") < got.index("16")


def test_boost_needs_several_articles(spark):
    c = spark.createDataFrame([chunk("c16", "t", article="16"), chunk("c7", "t", article="7")], CHUNK)
    hits = spark.createDataFrame([("q", "c7", 0.8)], "qid string, chunk_id string, score double")
    two = spark.createDataFrame([("q", "article 16 et article 7", "")], "qid string, text string, corpus string")
    assert {r.chunk_id: round(r.score, 6) for r in legal.boost_articles(hits, two, c).collect()} == {"c7": 0.8, "c16": 0.76}
    assert legal.boost_articles(hits, two.withColumn("text", F.lit("article 16")), c).count() == 1


def test_gate_and_hyde(spark):
    hits = spark.createDataFrame([("q", 0.5), ("q", 0.1), ("r", 0.1)], "qid string, score double")
    assert retrieve.min_score_gate(hits, 0.2).count() == 2
    assert [retrieve.wants_hyde(0.9, True), retrieve.wants_hyde(0.5), retrieve.wants_hyde(0.9)] == [True, True, False]


def test_fallback_of_an_asked_document(spark):
    import duckdb

    from lakeseek import catalog

    c = spark.createDataFrame([chunk(f"a{i}", f"laws of motion {i}", doc="a", corpus="x", pos=i) for i in range(5)] + [chunk("b", "natural selection", corpus="x")], CHUNK)
    q = spark.createDataFrame([("q", "zzz", ""), ("r", "laws", ""), ("s", "zzz", "y")], "qid string, text string, corpus string")
    p = retrieve.RetrieveParams(doc_id="a", top_k=3, min_score=0.0)
    got = retrieve.retrieve(index.build(c), q, p).collect()
    assert [(r.rank, r.chunk_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.qid == "q"] == [(1, "a0", 1.0), (2, "a1", 0.5), (3, "a2", 0.333333)]
    assert {r.qid for r in got} == {"q", "r"}
    got = retrieve.retrieve_variants(index.build(c), q.withColumn("variant", F.lit(0)), p).collect()
    assert sorted(r.chunk_id for r in got if r.qid == "q") == ["a0", "a1", "a2"] and not [r for r in got if r.qid == "s"]
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    for name in ("fallback_doc_chunks", "fallback_each_doc", "doc_filter_after_cap"):
        got, want = catalog.QUERIES[name](spark, sf), con.sql(catalog.ORACLE_SQL[name])
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and want.columns == got.columns


def test_eval_scores(spark):
    gold = spark.createDataFrame([("g", [], ["d2"], [], False, False), ("n", [], [], [], False, True), ("s", [], [], ["ARTICLE 5", "ARTICLE 7"], True, False)], "id string, expected_chunk_ids array<string>, expected_doc_ids array<string>, expected_sections array<string>, match_all_sections boolean, expect_no_results boolean")
    hits = spark.createDataFrame([("g", "c1", "d1", 1, "", ""), ("g", "c2", "d2", 2, "", ""), ("s", "c5", "d", 1, "ARTICLE 5", "5"), ("s", "c6", "d", 3, "ARTICLE 7", "7")], "qid string, chunk_id string, doc_id string, rank int, section string, article string")
    got = {r.id: r for r in evalkit.per_case(hits, gold).collect()}
    assert (got["g"].hit, got["g"].rr) == (True, 0.5) and got["n"].hit and got["s"].hit and got["s"].rr == 1.0


def test_totals_roll_up(spark):
    log = spark.createDataFrame([("ingest", "a", "x", 3, 1), ("ingest", "b", "", 2, 0), ("delete", "a", "x", 3, 1)], "event string, doc_id string, corpus string, chunks long, embedded long")
    assert {r.corpus: (r.documents, r.chunks, r.embedded) for r in stats.totals(log).collect()} == {None: (1, 2, 1), "x": (0, 0, 1), "_default": (1, 2, 0)}
    assert stats.manifest_warnings({"a": 1}, {"a": 2, "b": 3}) == ["a: index has 1, running 2"]


def corpora(spark, rows):
    return spark.createDataFrame([(i, "t", f"# Head\n\n{text} " * 3, "markdown", "", c, "", "") for i, text, c in rows], files.DOCUMENT)


def test_engine_keeps_the_types_of_corpora(spark, tmp_path):
    """Corpora that look like numbers, are empty or null, in two commits; a later one replaces, a delete and a compaction change no other."""
    text = "Words that fill a paragraph of some length for the index, number"
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(corpora(spark, [("a", f"{text} one", "2024"), ("b", f"{text} two", ""), ("c", f"{text} three", None)]))
    engine.ingest(corpora(spark, [("d", f"{text} four", "legal"), ("a", f"{text} five", "2024")]), commit="once")
    engine.ingest(corpora(spark, [("x", text, "never")]), commit="once")
    q = spark.createDataFrame([("q", "five", "2024"), ("r", "one", "2024"), ("s", "three", "")], "qid string, text string, corpus string")

    def state():
        at = engine.index()
        n = at.stats.first()
        return (
            {(r.doc_id, r.corpus) for r in at.chunks.collect()}, n.n, round(n.avgdl, 6), {r.term: r.df for r in at.term_df.collect()}, {(r.qid, r.doc_id, round(r.score, 9)) for r in engine.retrieve(q).collect()},
            {r.corpus: (r.documents, r.chunks) for r in engine.stats().collect()},
        )

    before = state()
    assert before[0] == {("a", "2024"), ("b", ""), ("c", ""), ("d", "legal")} and {(x[0], x[1]) for x in before[4]} == {("q", "a"), ("s", "c")}
    fresh = index.build(engine.index().chunks)
    assert before[3] == {r.term: r.df for r in fresh.term_df.collect()} and before[1] == fresh.stats.first().n and before[2] == round(fresh.stats.first().avgdl, 6)
    assert {(r.doc_id, r.corpus) for r in engine.documents().collect()} == {("a", "2024"), ("b", ""), ("c", None), ("d", "legal")}
    engine.compact()
    assert state() == before and len(engine._commits()) == 1
    assert engine.delete(["b", "b", "nobody"]) == 1 and engine.delete(["b"]) == 0
    after = state()
    assert after[1] == 3 and "two" not in after[3] and after[5]["_default"] == (1, 1)
    engine.ingest(corpora(spark, [("b", f"{text} six", "")]))
    assert state()[1] == 4 and state()[3]["six"] == 1
    engine.reset()
    assert engine.index().chunks.count() == 0 and engine.documents().count() == 0 and state()[5][None] == (0, 0)


def test_engine_searches_by_vectors(spark, tmp_path):
    """An embedder's vectors are stored with chunks and asked for queries; where it fails a chunk has none and is flagged. The manifest tells of other settings."""

    def embed(texts):
        if any("refused" in t for t in texts):
            raise RuntimeError("no")
        return [[float("sea" in t), float("star" in t), 0.1] for t in texts]

    text = "a paragraph that is long enough to be put into the index of the library as a chunk"
    engine = Engine(spark, str(tmp_path / "store"), embed, "toy")
    engine.ingest(corpora(spark, [("a", f"sea {text}", "x"), ("b", f"star {text}", "x"), ("c", f"refused {text}", "x")]).repartition(3))
    stored = {r.doc_id: (r.embedding is not None, r.embed_failed) for r in engine.index().chunks.collect()}
    assert stored["c"] == (False, True) and (stored["a"] == (True, False) or stored["a"] == (False, True))
    engine = Engine(spark, str(tmp_path / "store2"), embed, "toy")
    for i, word in (("a", "sea"), ("b", "star"), ("c", "refused")):
        engine.ingest(corpora(spark, [(i, f"{word} {text}", "x")]))
    assert {r.doc_id: r.embed_failed for r in engine.index().chunks.collect()} == {"a": False, "b": False, "c": True}
    q = spark.createDataFrame([("q", "sealing", "x")], "qid string, text string, corpus string")  # no chunk has the word
    assert [r.doc_id for r in engine.retrieve(q).orderBy("rank").collect()][0] == "a"
    assert engine.retrieve(q, expand=True).orderBy("rank").first().chunk_id.startswith("a-")
    assert engine.stats().where("corpus IS NULL").first().embedded == 2
    assert engine.warnings() == [] and Engine(spark, engine.root).warnings() == ["embeddings_enabled: index has True, running False", "embedding_model: index has 'toy', running ''"]


def test_engine_reports(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(corpora(spark, [("a", "Whales are large animals of the sea and sing long songs to each other at night", "c")]))
    gold = spark.createDataFrame([("g", "c", "whales", ["a"], {"Head": ["whales", "songs"], "Tail": ["x"]})], "id string, corpus string, retrieval_q string, expected_doc_ids array<string>, excerpt_terms_by_section map<string,array<string>>")
    gold = gold.selectExpr("*", "CAST(NULL AS string) AS generation_q", "CAST(NULL AS array<string>) AS expected_chunk_ids", "CAST(NULL AS array<string>) AS expected_sections", "false AS match_all_sections", "false AS expect_no_results")
    assert engine.evaluate(gold, path=str(tmp_path / "report")).first().recall_at_k == 1.0
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report.cases == 1 and report.per_case[0].id == "g" and report.mrr == 1.0
    assert {r.section: r.passed for r in engine.evaluate_excerpts(gold).collect()} == {"Head": True, "Tail": False}


LEGAL = """PRÉAMBULE
Nous, le peuple souverain, adoptons ce texte afin que nul n'ignore les règles qui gouvernent la cité commune.

Titre premier - LE PRÉSIDENT DE LA RÉPUBLIQUE

ARTICLE 5.

Le Président veille au respect de la Constitution par tous les pouvoirs publics. Il assure la continuité de l'État.

Titre II - LE PARLEMENT

ARTICLE 24.

Le Parlement vote la loi et contrôle l'action du gouvernement dans les formes prévues. Il évalue les politiques publiques.
"""


def test_legal_chunks_have_paths_and_neighbours(spark):
    d = spark.createDataFrame([("law", "loi", LEGAL, "markdown", "", "legal-demo", "", "")], files.DOCUMENT)
    got = {r.title: r for r in chunking.chunk_documents(chunking.normalize_documents(d)).collect()}
    assert {t: (r.section_path, r.article, r.source) for t, r in got.items()} == {
        "PRÉAMBULE": ("PRÉAMBULE", "", "markdown"),
        "ARTICLE 5.": ("Titre premier - LE PRÉSIDENT DE LA RÉPUBLIQUE -> ARTICLE 5.", "5", "markdown"),
        "ARTICLE 24.": ("Titre II - LE PARLEMENT -> ARTICLE 24.", "24", "markdown"),
    }
    five = got["ARTICLE 5."].text
    assert five.startswith("[Contexte précédent] PRÉAMBULE Nous, le peuple") and "[Contexte suivant] ARTICLE 24. Le Parlement vote la loi" in five
    hits = spark.createDataFrame([("q", "rôle du président", "legal-demo", "c", "5", "ARTICLE 5.", "", got["ARTICLE 5."].section_path, 1.0)], "qid string, query string, qcorpus string, chunk_id string, article string, title string, text string, section_path string, score double")
    far = legal.rerank(hits.withColumn("section_path", F.lit("Article 3"))).first().score
    assert round(legal.rerank(hits).first().score - far, 6) == 0.3


def test_heading_chunks_and_lists(spark):
    md = "intro text before any heading\n\n# One\n\nfirst *body* " + "word " * 30 + "\n\n```\n# not a heading\n```\n\n### Article two\n\nsecond body " + "more " * 30
    d = spark.createDataFrame([("d", "t", md, "markdown", "", "", "", ""), ("e", "t", "<h1>H &amp; M</h1><p>" + "text " * 30 + "</p><script>x</script><ul><li>a<li>b</ul>", "text/html", "", "", "", ""), ("n", None, None, None, None, None, None, None)], files.DOCUMENT)
    norm = chunking.normalize_documents(d)
    rows = {r.id: r for r in norm.collect()}
    assert rows["e"].content == "# H & M\n\n" + ("text " * 30).strip() + "\n\n- a\n\n- b" and rows["e"].original_content.startswith("<h1>") and rows["n"].content == ""
    got = [(r.doc_id, r.chunk_id, r.title, r.section_path, r.position) for r in chunking.chunk_documents(norm).orderBy("chunk_id").collect()]
    assert got == [("d", "d-chunk-0", "intro text before any heading", "intro text before any heading", 0), ("d", "d-chunk-2", "Article two", "Article 3", 1), ("e", "e-chunk-0", "H & M", "H & M", 0)]
    heads = {r.id: r.h for r in norm.select("id", chunking.headings(F.col("content")).alias("h")).collect()}
    assert heads == {"d": ["Titre 1: One", "Section 3: Article two"], "e": ["Titre 1: H & M"], "n": []}


def test_html_chunks(spark):
    page = "<html><head><title>T</title></head><body><h1>One</h1><p>First <b>bold</b><p>Second<h2>Two</h2><p>Third</p><ul><li>a<li>b <ul><li>c</ul></ul><div><p>inside</p></div><pre>code\\n</pre></body></html>"
    d = spark.createDataFrame([("d", page), ("n", None), ("e", "plain")], "id string, content string")
    got = [(r.chunk_id, r.title, r.text.replace("\\n", "")) for r in chunking.html_chunks(d).orderBy("position").collect()]
    want = [("One", "One"), ("One", "First bold"), ("One", "Second"), ("Two", "Two"), ("One", "Third"), ("", "a"), ("", "b c"), ("", "c"), ("", "code")]
    assert got == [(f"d-chunk-{i + 1}", *w) for i, w in enumerate(want)]


def test_bench_lines(spark, tmp_path):
    import io

    from lakeseek.jobs import cli

    engine, out = Engine(spark, str(tmp_path / "store")), io.StringIO()
    engine.ingest(corpora(spark, [("a", "Whales are large animals of the sea and sing long songs to each other at night", "c")]))
    cli.bench(engine, ["whales songs", "zzz"], out)
    head, one, none = out.getvalue().splitlines()
    assert head == "query,latency_ms,hits,doc_titles" and one.startswith("whales songs,") and one.endswith(",1,t") and none.endswith(",0,")


def test_normalised_texts(spark):
    import html
    import re

    texts = ["<p>a &lt;b&gt;</p>\n • \n-\n x  y ", "&amp;nbsp; <b\n>c</b>", "", "plain", "<script>s</script>\n*\nend"]

    def plain(t):
        lines = [x.strip(" ") for x in re.sub("<[^>]+>", " ", html.unescape(t)).split("\n")]
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", " ".join(x for x in lines if x not in ("", "•", "*", "-"))).strip(" ")

    from lakeseek.functions import text as X

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in rows.select(X.normalize_chunk_text(F.col("t")).alias("n")).collect()] == [plain(t) for t in texts]


def test_excerpts_by_hand(spark):
    from lakeseek.operators import excerpt

    long = "Rien ici. " * 100 + "La baleine chante longtemps la nuit. Une baleine nage. " + "Fin de tout. " * 40
    rows = spark.createDataFrame([("court et bon", "baleine"), (long, "baleine chante"), (long, "absent"), (long, "")], "t string, q string")
    got = [r.e for r in rows.select(excerpt.excerpt(F.col("t"), F.col("q"), F.lit("")).alias("e")).collect()]
    assert got[0] == "court et bon" and got[1] == "La baleine chante longtemps la nuit. Une baleine nage"
    assert got[2].startswith("Rien ici. Rien") and len(got[2]) <= 903 and got[3] == long[:900] + "..."


def test_prompts_have_system_and_checklist(spark):
    from lakeseek.operators import excerpt

    hits = spark.createDataFrame([("q", 1, "16", "L'Assemblée ne peut être dissoute", "legal", "ARTICLE 16", "loi"), ("q", 2, "7", "scrutin", "legal", "ARTICLE 7", "loi"), ("r", 1, "", "text", "web", "S", "S")], "qid string, rank int, article string, excerpt string, corpus string, section string, doc_title string")
    q = spark.createDataFrame([("q", "quel est le rôle"), ("r", "what is it")], "qid string, text string")
    got = {r.qid: r for r in excerpt.prompts(hits, q).collect()}
    assert got["q"].prompt.endswith("avec citation [n].\n") and "Rappel pour la partie (2)" in got["q"].prompt and got["q"].system.startswith("Réponds")
    assert got["r"].prompt == "Question: what is it\n\nExcerpts:\n[1] section=S\nTexte:\ntext\n\n" and got["r"].system.startswith("Answer")


def test_excerpt_queries(spark):
    q = spark.createDataFrame([("a", "r"), ("b", " "), ("c", None)], "qid string, retrieval_q string")
    v = spark.createDataFrame([("b", 1, "two"), ("b", 0, "one")], "qid string, variant int, text string")
    assert {r.qid: r.text for r in retrieve.excerpt_queries(q, v).collect()} == {"a": "r", "b": "one two", "c": ""}


def test_vectors_of_different_lengths_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"{i:03d}", "x" if i % 3 else "y", np.round(rng.normal(size=4 if i % 5 else 3), 1).tolist()) for i in range(120)] + [(f"d{i}", "x", [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [("z", "x", [0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, corpus string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([("a", "", [1.0, 1.0, 1.0, 1.0]), ("b", "x", [1.0, 1.0, 0.0]), ("c", "none", [1.0])], "qid string, corpus string, embedding array<double>")

    def cos(x, y):
        n = min(len(x), len(y))
        x, y = np.array(x[:n], np.float32).astype(float), np.array(y[:n])
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if np.linalg.norm(x) else 0.0

    got = {(r.qid, r.rank): r.chunk_id for r in vector.search(v, q, 7).collect()}
    for qid, corpus, e in (("a", "", [1.0] * 4), ("b", "x", [1.0, 1.0, 0.0])):
        best = sorted((-round(cos(x, e), 9), i) for i, c, x in rows if corpus in ("", c))[:7]
        assert [got[qid, k + 1] for k in range(7)] == [i for _, i in best]
    assert not [k for k in got if k[0] == "c"]


def test_engine_ingests_replaces_and_deletes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.md").write_text("# Whales\n\n" + "Whales are large animals of the sea and they sing long songs to each other at night. " * 2)
    (folder / "two.html").write_text("<h1>Stars</h1><p>" + "Stars are far away balls of hot gas that shine for a very long time in the dark sky. " * 2 + "</p><script>x</script>")
    (folder / "three.txt").write_text("not a document")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(files.read_directory(spark, str(folder), "c"))
    engine.ingest(files.read_directory(spark, str(folder), "c"))
    q = spark.createDataFrame([("q", "whales songs", "c"), ("r", "zzz", "c")], "qid string, text string, corpus string")
    hits = engine.retrieve(q).collect()
    assert {r.qid for r in hits} == {"q"} and hits[0].doc_title == "one"
    assert engine.index().chunks.select("doc_id").distinct().count() == 2
    assert "Question: whales songs" in engine.prompts(q).first().prompt
    assert engine.delete([hits[0].doc_id, "unknown"]) == 1
    assert engine.retrieve(q).count() == 0
    with pytest.raises(ValueError):
        engine.retrieve(q.withColumn("text", F.lit(" ")))


def test_stream_ingests_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"id": "d1", "title": "T", "content": "# Head\n\n" + "Words that fill a paragraph of some length for the index. " * 3, "corpus": "c"}))
    engine = Engine(spark, str(tmp_path / "store"))
    ingest_stream(engine, str(folder), str(tmp_path / "ck")).awaitTermination(120)
    assert engine.index().chunks.select("doc_id").distinct().collect()[0].doc_id == "d1"


def test_gold_is_read(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# c\n\n{"id": "a", "retrieval_q": "x", "excerpt_terms_by_section": {"s": ["t"]}}\n{"id": "b"}\n')
    gold = files.read_gold(spark, str(tmp_path / "g.jsonl"))
    assert gold.count() == 2 and files.invalid_gold(gold).first().id == "b"
