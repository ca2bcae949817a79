"""Text scalar functions as column expressions (no Python in the hot path)."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import terms as T


def let(value: Column, body) -> Column:
    """body(value) with value made once: a lambda that uses a column's expression would make it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(text: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    return F.size(fields(text)).cast("long")


def tokenize(text: Column) -> Column:
    """Index tokens: lower case, letters and digits of each word; 'article premier' and 'article 1er' are one token.

    One pass over the text takes out what is neither, one splits it; only texts that hold
    'article' before such a word are gone through word by word.
    """
    low = F.lower(text)
    split = lambda t: F.array_remove(F.split(t, r"\s+"), F.lit(""))
    return let(F.regexp_replace(low, r"[^\p{L}\p{N}\s]++", ""), lambda t: F.when(t.rlike(r"article\s+(?:premier|1er)"), _merged(low)).otherwise(split(t)))


def _merged(low: Column) -> Column:
    bare = F.transform(F.split(F.trim(low), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    joined = F.concat(F.lit(" "), F.array_join(bare, "  "), F.lit(" "))
    merged = F.regexp_replace(joined, " article  (premier|1er) ", " article\u0001$1 ")
    return F.transform(F.filter(F.split(merged, " +"), lambda w: w != ""), lambda w: F.replace(w, F.lit("\u0001"), F.lit(" ")))


def snippet_tokens(text: Column) -> Column:
    """Lower-case words without . , ; ! ? and stop words; repeats stay."""
    words = fields(F.translate(F.lower(text), ".,;!?", "     "))
    return F.filter(words, lambda w: ~w.isin(T.SNIPPET_STOPWORDS))


def query_token_set(query: Column) -> Column:
    return F.array_distinct(F.filter(snippet_tokens(query), lambda w: w != "article"))


def fold_accents(text: Column) -> Column:
    return F.translate(text, T.ACCENTS, T.FOLDED)


def legal_terms(query: Column) -> Column:
    """Distinct folded words of over two bytes."""
    words = fields(fold_accents(F.regexp_replace(F.lower(query), r"[^\p{L}\p{Nd}]", " ")))
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > 2))


def has_any(terms: Column, candidates: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, candidates)))


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".html", ".htm"), "html")


def title_from_path(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def stable_doc_id(path: Column) -> Column:
    return F.concat(F.lit("doc-"), F.sha1(path))


def strip_markup(text: Column) -> Column:
    """Tags become spaces, blank and bare bullet lines go, white space collapses."""
    lines = F.split(F.regexp_replace(text, "<[^>]+>", " "), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.isin("", "•", "*", "-"))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


@F.arrow_udf(StringType())
def unescape_html(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def normalize_chunk_text(text: Column) -> Column:
    """strip_markup of the decoded text."""
    return strip_markup(unescape_html(text))


def article_number(title: Column) -> Column:
    t = F.upper(F.trim(title))
    return F.when(t.startswith("ARTICLE PREMIER"), "1").otherwise(F.regexp_extract(t, "([0-9]+)", 1))


def has_articles(text: Column) -> Column:
    return text.rlike(r"(?im)^ARTICLE\s+(?:PREMIER|\d+)")


def article_refs(query: Column) -> Column:
    """Distinct articles that a query names, in order; premier is 1."""
    refs = F.regexp_extract_all(query, F.lit(r"(?i)article\s+(premier|\d+)"), F.lit(1))
    return F.array_distinct(F.transform(refs, lambda r: F.when(F.upper(r) == "PREMIER", "1").otherwise(r)))


def boundary_sentence(text: Column, from_end: bool) -> Column:
    """The last or first part, at '. ', of over 20 bytes; else the last or first part at all."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"\. "), lambda x: F.trim(x)), lambda p: p != "")
    long = F.filter(parts, lambda p: F.octet_length(p) > 20)
    at = -1 if from_end else 1
    return F.coalesce(F.try_element_at(long, F.lit(at)), F.try_element_at(parts, F.lit(at)), F.lit(""))


def strip_neighbor_context(text: Column) -> Column:
    """The text without the sentences put before and after it."""
    strip = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    t = strip(text)
    cut = F.regexp_replace(t, r"(?s)^\[Contexte précédent\].*?(?=ARTICLE |\n\n|$)", "")
    t = F.when(t.startswith(T.CONTEXT_BEFORE), strip(cut)).otherwise(t)
    return strip(F.substring_index(t, T.CONTEXT_AFTER, 1))


def anchor_article(text: Column, article: Column) -> Column:
    """From the article's own heading on, where it is found."""
    name = F.when(article == "1", F.greatest(F.locate("ARTICLE PREMIER", F.upper(text)), F.locate("ARTICLE 1", F.upper(text)))).otherwise(F.call_function("locate", F.concat(F.lit("ARTICLE "), article), F.upper(text)))
    return F.when((article != "") & (name > 0), F.substring(text, name, F.length(text))).otherwise(text)


def trim_to(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def strip_instructions(query: Column) -> Column:
    """Long queries (120 bytes or more) without an instruction put first, if 8 bytes are left."""
    q = F.trim(query)
    out = q
    rules = [r"^list \d+ ", r"^extrais uniquement (?:des |d')?extraits[,:]?\s*", r"^from the excerpts only[,:]?\s*"]
    rules += [rf"^.{{0,79}}?{p}[\s:,.]*" for p in ("extrais uniquement", "extrais uniquement des extraits", "from excerpts only", "from the excerpts only")]
    for rule in rules:  # the last that matches wins, so the strongest comes last
        rest = F.regexp_replace(q, "(?is)" + rule, "")
        out = F.when(q.rlike("(?is)" + rule) & (F.octet_length(rest) >= 8), rest).otherwise(out)
    return F.when(F.octet_length(q) < 120, q).otherwise(out)


def query_language(query: Column, override: Column | None = None) -> Column:
    low = F.lower(query)
    french = query.rlike(f"[{T.FRENCH_LETTERS}]")
    for w in T.FRENCH_WORDS:
        french = french | low.contains(f" {w} ") | low.startswith(f"{w} ")
    found = F.when(french, "fr").otherwise("en")
    return found if override is None else F.when(override.isin("fr", "en"), override).otherwise(found)


def heading_prefix(level: Column) -> Column:
    names = F.element_at(F.array(*map(F.lit, ("Titre", "Chapitre", "Section", "Paragraphe"))), level.cast("int"))
    return F.when(level.between(1, 4), names).otherwise(F.concat(F.lit("Article-"), level.cast("string")))


def section_path(title: Column, position: Column) -> Column:
    """'Article 3' and the like for titles that start so; any other title is its own path."""
    low = F.lower(F.trim(title))
    out = title
    for name in ("Paragraphe", "Section", "Chapitre", "Article"):
        out = F.when(low.startswith(name.lower()), F.concat(F.lit(name + " "), (position + 1).cast("string"))).otherwise(out)
    return out


def section_matches(section: Column, article: Column, want: Column) -> Column:
    """Whether a hit is of the section that is wanted, by a part of its name or by its article; a blank one is none's."""
    w = F.upper(F.btrim(want, F.lit(" \t\r\n")))
    return (w != "") & (F.contains(F.upper(section), w) | ((article != "") & F.contains(w, F.concat(F.lit("ARTICLE "), F.upper(article)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.transform(F.slice(x, F.lit(1), n), lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def params(text: Column) -> Column:
    """key=value lines as a map; blank and # lines are left out, the last of equal keys wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
