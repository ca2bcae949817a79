"""Query expansion and reranking by rule, for legal corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X
from ..session import cut
from . import lexical


def is_legal(corpus: Column) -> Column:
    """Corpora whose queries are expanded by rule."""
    return F.contains(F.lower(corpus), F.lit("legal"))


def expansions(query: Column) -> Column:
    """The query, then a variant for each rule that its words meet; distinct but for case."""
    return X.let(F.struct(F.trim(query).alias("q"), X.legal_terms(query).alias("t")), lambda x: _expansions(x["q"], x["t"]))


def _expansions(q: Column, t: Column) -> Column:
    low = F.lower(q)
    has = lambda *w: X.has_any(t, list(w))
    president, abstract, election = has(*T.PRESIDENT), X.has_any(t, T.ABSTRACT_INTENT), X.has_any(t, T.ELECTION)
    emergency = X.has_any(t, T.EMERGENCY)
    rules = {
        "article_one": (has("premier") | low.contains("article 1") | low.contains("article premier")) & has("republique", "republic"),
        "president_role": president & abstract & ~election,
        "president_election": president & election,
        "emergency": emergency,
        "emergency_election": emergency & (president | election),
        "parliament": has("parlement") & abstract,
        "government": has("gouvernement") & abstract,
    }
    added = F.array(*(F.when(cond, F.concat(q, F.lit(" " + T.EXPANSIONS[name]))) for name, cond in rules.items()))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(q), F.array_compact(added)))


def is_abstract(query: Column) -> Column:
    """Short, names no article, and asks for an institution or a role."""
    t, q = X.legal_terms(query), F.trim(query)
    return (q != "") & (F.octet_length(q) < 200) & (F.size(X.article_refs(q)) == 0) & (X.has_any(t, T.INSTITUTIONS) | X.has_any(t, T.ABSTRACT_INTENT))


def parse_rewrites(raw: Column) -> Column:
    """Queries of a model's answer: a line each, without 'Requête n :'; those under 4 bytes go."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^requ[êe]te\s*\d*\s*:\s*", "")))
    return F.filter(lines, lambda x: F.octet_length(x) >= 4)


def affinity(terms: Column, article: Column) -> Column:
    """Bonus of an article for a query's terms."""
    president, election, abstract = X.has_any(terms, T.PRESIDENT), X.has_any(terms, T.RERANK_ELECTION), X.has_any(terms, T.RERANK_ABSTRACT)
    people = F.array_contains(terms, "peuple")
    rows = [(X.has_any(terms, words) & article.isin(articles), bonus) for words, articles, bonus in T.AFFINITIES]
    rows += [(president & abstract & ~election & (article == "5"), 0.45), (president & ~election & article.isin("5", "6"), 0.25), (people & ~president & article.isin("1", "2", "3"), 0.20)]
    return sum((F.when(cond, bonus).otherwise(0.0) for cond, bonus in rows), F.lit(0.0))


def penalty(terms: Column, article: Column) -> Column:
    return F.when(F.array_contains(terms, "peuple") & X.has_any(terms, T.PRESIDENT) & article.isin("1", "2", "3"), 0.15).otherwise(0.0)


def path_bonus(terms: Column, path: Column) -> Column:
    up = F.upper(path)
    return F.when(X.has_any(terms, T.PRESIDENT) & (up.contains("PRESIDENT DE LA REPUBLIQUE") | up.contains("PRÉSIDENT DE LA RÉPUBLIQUE")), 0.30).otherwise(0.0)


def overlap_bonus(terms: Column, title: Column, text: Column) -> Column:
    """0.04 for each word among the first 400 characters of title and text that the query has (words keep their accents)."""
    head = F.left(F.lower(F.concat_ws(" ", title, X.strip_neighbor_context(text))), F.lit(400))
    words = X.fields(F.regexp_replace(head, r"[^\p{L}\p{Nd}]", " "))
    return X.let(terms, lambda t: F.size(F.filter(words, lambda w: F.array_contains(t, w)))) * F.lit(0.04)


def rerank(hits: DataFrame, enabled: bool | None = None) -> DataFrame:
    """hits (qid, query, qcorpus, chunk columns, score) with the score that the rules give; for legal corpora, or where any hit has an article."""
    on = F.lit(enabled) if enabled is not None else (F.col("qcorpus") == "legal-demo") | F.max(F.col("article") != "").over(Window.partitionBy("qid"))
    t = X.legal_terms(F.col("query"))
    rows = hits.withColumn("__on", on).withColumn("__t", t)
    bonus = affinity(F.col("__t"), F.col("article")) + overlap_bonus(F.col("__t"), F.col("title"), F.col("text")) + path_bonus(F.col("__t"), F.col("section_path"))
    return rows.withColumn("score", F.when(F.col("__on"), F.col("score") * (1 + bonus) * (1 - penalty(F.col("__t"), F.col("article")))).otherwise(F.col("score"))).drop("__on", "__t")


def boost_articles(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """For queries that name several articles: all chunks of those that aren't hits yet, at 0.95 of the best score (1 without hits).

    That can be a share of all chunks for each query, so what is added is made where the
    chunks are: a chunk brings the queries that it is a hit of, an article its queries
    and their best score.
    """
    refs = queries.select("qid", F.coalesce("corpus", F.lit("")).alias("qcorpus"), X.article_refs(F.col("text")).alias("refs")).where("size(refs) > 1").select("qid", "qcorpus", F.explode("refs").alias("article"))
    named = lexical.held(refs)
    if named is not None:
        if not named.num_rows:
            return hits.select("qid", "chunk_id", "score")
        refs = F.broadcast(refs.sparkSession.createDataFrame(named, refs.schema))
    hits = cut(hits, "hits")  # read three times from here
    asked = refs.join(lexical.local(hits.groupBy("qid").agg(F.max("score").alias("top"))), "qid", "left")
    asked = asked if named is None else lexical.local(asked)
    known = lexical.local(hits.join(refs.select("qid").distinct(), "qid", "left_semi").groupBy("chunk_id").agg(F.collect_set("qid").alias("__of")))
    rows = chunks.where("article <> ''").select("chunk_id", "corpus", "article").join(known, "chunk_id", "left")
    more = rows.join(asked, "article").where("(qcorpus = '' OR qcorpus = corpus) AND NOT coalesce(array_contains(__of, qid), false)")
    return hits.select("qid", "chunk_id", "score").unionByName(more.select("qid", "chunk_id", (0.95 * F.coalesce("top", F.lit(1 / 0.95))).alias("score")))
