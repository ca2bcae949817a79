from pyspark.sql import functions as F

from lakeseek.functions import text as X
from lakeseek.operators import excerpt, legal


def one(spark, expr, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(expr.alias("x")).first().x


def test_token_count(spark):
    assert one(spark, X.count_tokens(F.col("t")), t="hello world") == 2
    assert one(spark, X.count_tokens(F.col("t")), t="") == 0


def test_tokenize_merges_article_premier(spark):
    assert one(spark, X.tokenize(F.col("t")), t="L'article premier, Article 1er x") == ["larticle", "premier", "article 1er", "x"]
    assert one(spark, X.tokenize(F.col("t")), t="article — premier") == ["article", "premier"]


def test_heading_prefix(spark):
    rows = spark.range(1, 6).select(X.heading_prefix(F.col("id")).alias("x")).collect()
    assert [r.x for r in rows] == ["Titre", "Chapitre", "Section", "Paragraphe", "Article-5"]


def test_article_refs_in_order(spark):
    assert one(spark, X.article_refs(F.col("t")), t="article 16, article 7 et Article 16") == ["16", "7"]
    assert one(spark, X.article_refs(F.col("t")), t="l'article premier") == ["1"]


def test_fold_and_terms(spark):
    assert one(spark, X.legal_terms(F.col("t")), t="Rôle du Président, à l'élection") == ["role", "president", "election"]


def test_strip_markup(spark):
    assert one(spark, X.normalize_chunk_text(F.col("t")), t="<p>a &amp;  b</p>\n•\n-\n c") == "a & b c"


def test_instructions_are_stripped_only_from_long_queries(spark):
    q = "From the excerpts only, list what the law says about the election of the president and the length of the term that follows from it"
    assert one(spark, X.strip_instructions(F.col("t")), t=q).startswith("list what the law")
    assert one(spark, X.strip_instructions(F.col("t")), t="from the excerpts only, x") == "from the excerpts only, x"


def test_neighbor_context_is_stripped(spark):
    t = "[Contexte précédent]\nBefore it.\n\nARTICLE 5.\nBody.\n\n[Contexte suivant]\nAfter it."
    assert one(spark, X.strip_neighbor_context(F.col("t")), t=t) == "ARTICLE 5.\nBody."


def test_boundary_sentence(spark):
    assert one(spark, X.boundary_sentence(F.col("t"), True), t="A long enough first sentence. A long enough last sentence. End") == "A long enough last sentence"
    assert one(spark, X.boundary_sentence(F.col("t"), False), t="") == ""


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, X.cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, X.cosine(a, F.array(F.lit(0.0)))) == 0.0


def test_params(spark):
    assert one(spark, X.params(F.col("t")), t="a=1\n# c\n\nb = x=y\na=2") == {"b": "x=y", "a": "2"}


def test_expansions(spark):
    assert len(one(spark, legal.expansions(F.col("t")), t="rôle du président")) == 2
    assert one(spark, legal.expansions(F.col("t")), t=" ") == []
    assert one(spark, legal.is_abstract(F.col("t")), t="obligations du président") is True
    assert one(spark, legal.is_abstract(F.col("t")), t="article 5 du président") is False


def test_snippet_takes_the_best_sentences(spark):
    t = "Nothing here at all. The election of the president is set. Other words. " + "x" * 900
    got = one(spark, excerpt.snippet(F.col("t"), F.lit("election president"), 100), t=t)
    assert got == "The election of the president is set"
