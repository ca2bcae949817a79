"""Excerpts of hits and prompt assembly: on the few rows of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X
from . import lexical

EXCERPT, LEGAL, HEAD, PROMPT, SENTENCES = 900, 2200, 1200, 6000, 3


def _priority(low: Column) -> Column:
    """Priority terms in a lower-case text."""
    return F.filter(F.array(*map(F.lit, T.PRIORITY_TERMS)), lambda t: F.contains(low, t))


def heading_only(sentence: Column) -> Column:
    return F.trim(sentence).rlike(r"(?i)^ARTICLE\s+(?:PREMIER|\d+)\.?\s*$")


def _count_terms(low: Column, query_terms: Column) -> Column:
    """Words of a lower-case sentence that are among the terms (those of X.snippet_tokens()): each term's places are counted in the sentence with two spaces between words, which costs a look through it a term and makes no words."""
    marks = ".,;!?\t\n\u000b\f\r"
    apart = F.concat(F.lit(" "), F.replace(F.translate(low, marks, " " * len(marks)), F.lit(" "), F.lit("  ")), F.lit(" "))
    places = lambda x, w: (F.octet_length(x) - F.octet_length(F.replace(x, w, F.lit("")))) / F.octet_length(w)
    return X.let(apart, lambda x: F.aggregate(query_terms, F.lit(0), lambda n, w: n + places(x, F.concat(F.lit(" "), w, F.lit(" "))).cast("int")))


def scored_sentences(text: Column, query_terms: Column) -> Column:
    """[(s, score)] of sentences(): a sentence's words that the query has, repeats included, and priority terms found.

    query_terms are distinct words of X.snippet_tokens(). They and the priority terms are
    looked for in the whole text first; sentences are asked only for those that it has.
    """
    known = X.let(F.lower(text), _priority)
    query_terms = X.let(F.struct(F.lower(text).alias("low"), query_terms.alias("q")), lambda x: F.filter(x["q"], lambda w: F.contains(x["low"], w)))
    each = lambda s, x: X.let(F.lower(s), lambda v: _count_terms(v, x["q"]) + F.size(F.filter(x["known"], lambda t: F.contains(v, t))))
    return X.let(F.struct(known.alias("known"), query_terms.alias("q")), lambda x: F.transform(sentences(text), lambda s: F.struct(s.alias("s"), each(s, x).alias("score"))))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\. "), lambda x: F.trim(x))
    return F.filter(parts, lambda s: (s != "") & ~heading_only(s))


def _pack(parts: Column, budget: Column) -> Column:
    """Parts in order, three at most, as long as they fit the budget; stops at the first that doesn't."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(acc, part):
        joined = F.when(acc["n"] == 0, part).otherwise(F.concat(acc["text"], F.lit(". "), part))
        stop = acc["full"] | (acc["n"] >= SENTENCES) | (F.length(joined) > budget)
        return F.struct(F.when(stop, acc["text"]).otherwise(joined).alias("text"), F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"), stop.alias("full"))

    return F.aggregate(parts, empty, add, lambda a: a["text"])


def legal_excerpt(text: Column, limit: int) -> Column:
    """The head, and sentences with priority terms that it doesn't hold; or the text cut."""
    head = F.left(text, F.lit(HEAD))
    budget = F.lit(limit) - F.length(head) - 2
    told = lambda s, x: X.let(F.lower(s), lambda v: F.exists(x["known"], lambda t: F.contains(v, t)) & ~F.contains(x["head"], v))
    new = X.let(F.struct(X.let(F.lower(text), _priority).alias("known"), F.lower(head).alias("head")), lambda x: F.filter(sentences(text), lambda s: told(s, x)))
    tail = _pack(new, budget)
    merged = F.when((budget > 80) & (tail != ""), X.trim_to(F.concat(head, F.lit("\n\n"), tail), limit)).otherwise(X.trim_to(text, limit))
    return F.when(F.length(text) <= limit, text).otherwise(merged)


def snippet(text: Column, query: Column, limit: int) -> Column:
    """The best scored sentences (longer first among equals); without a query the text cut, without a match legal_excerpt()."""
    return X.let(F.struct(text.alias("t"), X.query_token_set(query).alias("q")), lambda x: _snippet(x["t"], x["q"], limit))


def _snippet(text: Column, terms: Column, limit: int) -> Column:
    scored = F.transform(scored_sentences(text, terms), lambda x: F.struct((-x["score"]).alias("score"), (-F.length(x["s"])).alias("n"), x["s"].alias("s")))
    best = F.transform(F.filter(F.array_sort(scored), lambda x: x["score"] < 0), lambda x: x["s"])

    def pick(b: Column) -> Column:
        first = F.get(b, F.lit(0))
        packed = F.when(F.length(first) > limit, X.trim_to(first, limit)).otherwise(_pack(b, F.lit(limit)))
        return F.when(F.size(b) == 0, legal_excerpt(text, limit)).otherwise(packed)

    return F.when(F.size(terms) == 0, X.trim_to(text, limit)).otherwise(X.let(best, pick))


def excerpt(text: Column, query: Column, article: Column, limit: int = EXCERPT) -> Column:
    """What of a chunk is shown for a query: whole if it fits; articles from their heading on, with more room."""
    return X.let(X.anchor_article(X.strip_neighbor_context(text), article), lambda t: _excerpt(t, query, article, limit))


def _excerpt(t: Column, query: Column, article: Column, limit: int) -> Column:
    legal = (article != "") | X.has_articles(t)
    return F.when(legal & (F.length(t) <= LEGAL), t).when(~legal & (F.length(t) <= limit), t).when(legal, legal_excerpt(t, LEGAL)).otherwise(snippet(t, query, limit))


def with_excerpts(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with column excerpt."""
    texts = chunks.select("chunk_id", "text").join(lexical.local(hits), "chunk_id")
    q = queries.select("qid", F.col("text").alias("query"))
    return texts.join(lexical.local(q), "qid").withColumn("excerpt", excerpt(F.col("text"), F.col("query"), F.col("article"))).drop("text", "query")


def within_budget(rows: DataFrame, by: str, order: str, text: str, budget: int = PROMPT) -> DataFrame:
    """Rows of each group, in order, up to the first that would go over the budget of characters."""
    used = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used.cast("long")).where(F.col("used") <= budget)


def is_legal_result() -> Column:
    """Whether any hit of the query is of a legal corpus or an article."""
    return F.max((F.col("article") != "") | F.contains(F.lower("corpus"), F.lit("legal"))).over(Window.partitionBy("qid"))


def checklist(hits: DataFrame) -> DataFrame:
    """(qid, checklist) of hits with excerpts: reminders for articles 16 (where its excerpt says 'dissoute') and 7; '' without either."""
    art = F.trim("article")
    of = hits.groupBy("qid").agg(F.bool_or((art == "16") & F.contains(F.lower("excerpt"), F.lit("dissoute"))).alias("a16"), F.bool_or(art == "7").alias("a7"))
    lines = F.concat(F.when(F.col("a16"), T.CHECK_16).otherwise(""), F.when(F.col("a7"), T.CHECK_7).otherwise(""))
    return of.select("qid", F.when(F.col("a16") | F.col("a7"), F.concat(F.lit(T.CHECK_HEAD), lines)).otherwise("").alias("checklist"))


def system_prompt(lang: Column, prompts: dict[str, str] | None = None) -> Column:
    """The instruction for an answer's language: French or, for any other, English. prompts: others than the library's."""
    p = T.SYSTEM_PROMPTS if prompts is None else prompts
    return F.when(lang == "fr", F.lit(p["fr"])).otherwise(F.lit(p["en"]))


def prompts(hits: DataFrame, queries: DataFrame, top_k: int = 8, legal_k: int = 4) -> DataFrame:
    """(qid, system, prompt): after the question numbered excerpts within the budget, and the checklist where it still fits; legal results show fewer."""
    rows = hits.withColumn("__k", F.when(is_legal_result(), min(top_k, legal_k)).otherwise(top_k)).where(F.col("rank") <= F.col("__k"))
    path = F.when((F.col("doc_title") != "") & (F.col("doc_title") != F.col("section")), F.concat_ws(" -> ", "doc_title", "section")).otherwise(F.col("section"))
    art = F.when(F.col("article") != "", F.concat(F.lit(" article="), F.col("article"))).otherwise("")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] section="), path, art, F.lit("\nTexte:\n"), F.col("excerpt"), F.lit("\n\n"))
    shown = within_budget(rows.withColumn("block", block), "qid", "rank", "block")
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "")
    shown = shown.groupBy("qid").agg(blocks.alias("b")).join(checklist(rows), "qid")
    more = F.when(F.length("b") + F.length("checklist") <= PROMPT, F.col("checklist")).otherwise("")
    asked = queries.select("qid", F.col("text").alias("query"))
    text = F.concat(F.lit("Question: "), "query", F.lit("\n\nExcerpts:\n"), "b", more)
    return shown.join(lexical.local(asked), "qid").select("qid", system_prompt(X.query_language(F.col("query"))).alias("system"), text.alias("prompt"))
