"""The library's own queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for them.

documents stand for whole-document chunks: corpus = lang, doc_title = source, title =
first line. Search queries are the first words of every document whose id is
divisible by 100 (and its embedding), against all rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import terms as T
from .functions import text as X
from .operators import chunking, embedding, evalkit, excerpt, fusion, generation, index, legal, lexical, retrieve, stats, vector
from .session import cut, new_path, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("corpus"),
        F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("title"), F.coalesce("source", F.lit("")).alias("doc_title"), F.lit("document").alias("section_path"), F.lit(0).alias("position"),
        F.lit("").alias("article"), F.coalesce("text", F.lit("")).alias("text"),
    )


def asked(spark: SparkSession, sf_dir: str, corpus: bool = False, doubled: bool = False) -> DataFrame:
    """Queries: words 3 to 8 of every document whose id is divisible by 100."""
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    text = F.array_join(F.slice(X.fields(F.coalesce("text", F.lit(""))), 3, 6), " ")
    text = F.concat_ws(" ", text, F.element_at(F.split(text, " "), 1)) if doubled else text
    return d.select(F.col("doc_id").cast("string").alias("qid"), text.alias("text"), (F.col("lang") if corpus else F.lit("")).alias("corpus"))


#: Where an application has put its index of a folder of tables: built once, read by all queries.
_BUILT: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored index of chunks_of(), with the vectors of embeddings."""
    key, chunks = (spark.sparkContext.applicationId, sf_dir), chunks_of(spark, sf_dir)
    if key not in _BUILT:
        path = new_path(spark, "index")
        index.build(spread(chunks), path, kept=False)
        _BUILT[key] = path
    return replace(index.load(spark, _BUILT[key], chunks), vectors=vectors_of(spark, sf_dir))


# DuckDB pieces
FIELDS_SQL = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> '')"
TOK = "list_transform(list_filter(string_split_regex(regexp_replace(' ' || array_to_string(list_transform(string_split_regex(trim(lower({0})), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '  ') || ' ', ' article  (premier|1er) ', ' article' || chr(1) || '\\1 ', 'g'), ' +'), lambda w: w <> ''), lambda w: replace(w, chr(1), ' '))"
SNIP = "list_filter(list_filter(string_split_regex(trim(translate(lower({0}), '.,;!?', '     ')), '\\s+'), lambda w: w <> ''), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.SNIPPET_STOPWORDS) + "))"
FOLD = f"translate({{0}}, '{T.ACCENTS}', '{T.FOLDED}')"
TERMS = "list_distinct(list_filter(list_filter(string_split_regex(trim(" + FOLD.format("regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]', ' ', 'g')") + "), '\\s+'), lambda w: w <> ''), lambda w: strlen(w) > 2))"
HOST_PATH = "regexp_replace(url, '^[a-z]+://', '')"
CHUNKS = "c AS (SELECT doc_id::VARCHAR AS chunk_id, coalesce(lang, '') AS corpus, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(source, '') AS doc_title, coalesce(text, '') AS text FROM documents WHERE coalesce(text, '') <> '')"
POST = (
    CHUNKS
    + ", ft AS (SELECT chunk_id, corpus, 'text' AS field, "
    + TOK.format("text")
    + " AS t FROM c UNION ALL SELECT chunk_id, corpus, 'title', "
    + TOK.format("title")
    + " FROM c UNION ALL SELECT chunk_id, corpus, 'doc_title', "
    + TOK.format("doc_title")
    + " FROM c UNION ALL SELECT chunk_id, corpus, 'section', "
    + TOK.format("CASE WHEN title <> '' THEN title ELSE 'document' END")
    + " FROM c), ex AS (SELECT chunk_id, corpus, field, len(t) AS dl, unnest(t) AS term FROM ft), po AS (SELECT chunk_id, corpus, field, term, dl, count(*) AS tf FROM ex GROUP BY ALL), df AS (SELECT term, count(DISTINCT chunk_id) AS df FROM po GROUP BY term), st AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT sum(len(t)) FROM ft) / (SELECT count(*) FROM c) AS avgdl)"
)
BOOST = "CASE field " + " ".join(f"WHEN '{k}' THEN {v:.1f}" for k, v in T.BOOSTS.items()) + " END"


def asked_sql(corpus: bool = False, doubled: bool = False) -> str:
    words = FIELDS_SQL.format("coalesce(text, '')")
    text = f"array_to_string(list_slice({words}, 3, 8), ' ')"
    text = f"{text} || ' ' || string_split({text}, ' ')[1]" if doubled else text
    return f"qs AS (SELECT doc_id::VARCHAR AS qid, {text} AS q, {'lang' if corpus else chr(39) * 2} AS qc FROM documents WHERE doc_id % 100 = 0), qe AS (SELECT qid, qc, unnest({TOK.format('q')}) AS term FROM qs), qt AS (SELECT qid, qc, term, count(*) AS qtf FROM qe GROUP BY ALL)"


def bm25_sql(combine: str = "max", fields: str | None = None, corpus: bool = False, doubled: bool = False, k: int = 20) -> str:
    """CTEs that end in hits(qid, chunk_id, score, rank)."""
    only = f" AND field IN ({fields})" if fields else ""
    return (
        f"WITH {POST}, {asked_sql(corpus, doubled)}, pf AS (SELECT qid, chunk_id, field, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x FROM po JOIN qt USING (term) JOIN df USING (term), st WHERE (qc = '' OR qc = corpus){only} GROUP BY ALL), "
        f"sc AS (SELECT qid, chunk_id, {combine}(x * {BOOST}) AS score FROM pf GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0), hits AS (SELECT * FROM rk WHERE rank <= {k})"
    )


OUT_HITS = " SELECT qid, chunk_id, round(score, 6) AS score, rank FROM hits"


def out_hits(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- text functions over whole tables


@query(f"SELECT doc_id, len({FIELDS_SQL.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query(f"SELECT doc_id, md5(array_to_string({TOK.format('text')}, ' ')) AS h, len({TOK.format('text')})::BIGINT AS n FROM documents")
def tokenize_hash(spark, sf_dir):
    t = X.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(t, " ")).alias("h"), F.size(t).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({SNIP.format('text')}, ' ')) AS h, len({SNIP.format('text')})::BIGINT AS n FROM documents")
def snippet_tokens(spark, sf_dir):
    t = X.snippet_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(t, " ")).alias("h"), F.size(t).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string(list_sort({TERMS.format('text')}), ' ')) AS h FROM documents")
def accent_fold_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(X.legal_terms(F.col("text"))), " ")).alias("h"))


@query()
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_chunk_text(F.col("html")).alias("text"))


@query(
    "SELECT page_id, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x NOT IN ('', '•', '*', '-')), ' '), '\\s+', ' ', 'g'))) AS h FROM pages"
)
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_markup(F.col("html"))).alias("h"))


@query(
    "WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.HTML' WHEN 2 THEN '.pdf' ELSE '' END AS path FROM pages) "
    "SELECT page_id, CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.markdown') THEN 'markdown' WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.html', '.htm') THEN 'html' END AS content_type, "
    "regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS title, 'doc-' || sha1(path) AS id FROM p"
)
def source_paths(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".md", ".HTML", ".pdf", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), ext).alias("path"))
    return p.select("page_id", X.content_type(F.col("path")).alias("content_type"), X.title_from_path(F.col("path")).alias("title"), X.stable_doc_id(F.col("path")).alias("id"))


@query(
    f"SELECT doc_id, CASE WHEN regexp_matches(text, '[{T.FRENCH_LETTERS}]') OR "
    + " OR ".join(f"contains(lower(text), ' {w} ') OR starts_with(lower(text), '{w} ')" for w in T.FRENCH_WORDS)
    + " THEN 'fr' ELSE 'en' END AS lang_found FROM documents"
)
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.query_language(F.col("text")).alias("lang_found"))


@query("SELECT doc_id, array_to_string(list_distinct(list_sort(list_transform(regexp_extract_all(text, '(?i)article\\s+(premier|\\d+)', 1), lambda r: CASE WHEN upper(r) = 'PREMIER' THEN '1' ELSE r END))), ',') AS refs, regexp_matches(text, '(?im)^ARTICLE\\s+(?:PREMIER|\\d+)') AS legal FROM documents")
def article_refs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(X.article_refs(F.col("text"))), ",").alias("refs"), X.has_articles(F.col("text")).alias("legal"))


# --- chunking


@query(
    f"WITH w AS (SELECT doc_id, {FIELDS_SQL.format('text')} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 600) / 540.0))::BIGINT + 1)) AS position FROM w WHERE len(w) > 0) "
    "SELECT doc_id, position::BIGINT AS position, md5(array_to_string(list_slice(w, position * 540 + 1, position * 540 + 600), ' ')) AS h FROM i"
)
def token_windows(spark, sf_dir):
    return chunking.token_windows(table(spark, sf_dir, "documents")).select("doc_id", F.col("position").cast("long").alias("position"), F.md5("text").alias("h"))


_PARTS = "list_filter(list_transform(string_split(trim({0}), '. '), lambda p: trim(p)), lambda p: p <> '')"
_BOUND = "coalesce(list_filter({p}, lambda p: strlen(p) > 20)[{i}], {p}[{i}], '')"


@query(
    "WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER w AS b, lead(coalesce(text, '')) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    f"s AS (SELECT conv_id, turn, text, {_BOUND.format(p=_PARTS.format('b'), i=-1)} AS b, {_BOUND.format(p=_PARTS.format('a'), i=1)} AS a FROM l) "
    f"SELECT conv_id, turn, md5(CASE WHEN b <> '' THEN '{T.CONTEXT_BEFORE} ' || b || '.' || chr(10) || chr(10) ELSE '' END || text || CASE WHEN a <> '' THEN chr(10) || chr(10) || '{T.CONTEXT_AFTER} ' || a ELSE '' END) AS h FROM s"
)
def neighbor_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return chunking.neighbor_context(rows, "conv_id", "turn").select("conv_id", "turn", F.md5("context").alias("h"))


@query("SELECT conv_id, turn, strlen(trim(coalesce(text, ''))) >= 80 AND (trim(role) = '' OR lower(trim(coalesce(text, ''))) <> lower(trim(role))) AS indexable FROM conversations")
def indexable_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.is_indexable(F.col("text"), F.col("role")).alias("indexable"))


@query()
def merge_small(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.merge_small(rows, "conv_id", "turn")


@query()
def heading_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    docs = p.select(F.col("page_id").cast("string").alias("id"), F.lit("").alias("title"), F.col("html").alias("content"), F.lit("html").alias("content_type"), F.lit("").alias("original_content"), F.lit("web").alias("corpus"), F.lit("").alias("book_title"), F.lit("").alias("article"))
    return chunking.chunk_documents(chunking.normalize_documents(docs))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", chunking.to_markdown(F.col("html")).alias("markdown"))


@query()
def markdown_text(spark, sf_dir):
    """Plain text of every document and page, read as Markdown."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), chunking.to_markdown(F.col("html")).alias("text"))
    return d.union(p).select("kind", "id", chunking.to_text(F.col("text")).alias("text"))


# --- index and statistics


@query(f"WITH {POST} SELECT chunk_id, field, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(tf) AS most FROM po GROUP BY ALL")
def term_frequency(spark, sf_dir):
    po = index.postings(index.chunk_fields(spread(chunks_of(spark, sf_dir))))
    return po.groupBy("chunk_id", "field").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query(f"WITH {POST} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def doc_frequency(spark, sf_dir):
    f = index.chunk_fields(chunks_of(spark, sf_dir))
    return index.term_df(index.postings(f)).crossJoin(F.broadcast(index.corpus_stats(f))).select("term", "df", F.round(index.idf(F.col("df"), F.col("n")), 6).alias("idf"))  # a row of statistics


@query(f"WITH {POST} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(index.chunk_fields(chunks_of(spark, sf_dir))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CHUNKS} SELECT chunk_id, len({TOK.format('text')})::BIGINT AS len_text, len({TOK.format('title')})::BIGINT AS len_title, len({TOK.format('doc_title')})::BIGINT AS len_doc_title, len({TOK.format('CASE WHEN title <> ' + chr(39) * 2 + ' THEN title ELSE ' + chr(39) + 'document' + chr(39) + ' END')})::BIGINT AS len_section, 0::BIGINT AS len_article FROM c")
def field_lengths(spark, sf_dir):
    return index.field_lengths(index.chunk_fields(chunks_of(spark, sf_dir)))


# --- retrieval


@query(bm25_sql(fields="'text'") + OUT_HITS)
def bm25_text_topk(spark, sf_dir):
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir), fields=("text",)))


@query(bm25_sql() + OUT_HITS)
def bm25_multifield_max(spark, sf_dir):
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir)))


@query(bm25_sql() + OUT_HITS)
def bm25_pruned(spark, sf_dir):
    """The same hits, where blocks of chunks that can't hold one of the 20 best are not scored."""
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir), prune=True))


@query(bm25_sql("sum") + OUT_HITS)
def bm25_multifield_sum(spark, sf_dir):
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir), combine="sum"))


@query(bm25_sql(corpus=True) + OUT_HITS)
def bm25_corpus_filter(spark, sf_dir):
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir, corpus=True)))


@query(bm25_sql(doubled=True) + OUT_HITS)
def bm25_repeat_terms(spark, sf_dir):
    return out_hits(lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir, doubled=True)))


def vectors_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("corpus"), "embedding")


def vector_sql(same_label: bool, k: int = 20) -> str:
    """CTE vh(qid, chunk_id, score, rank)."""
    cond = "WHERE q.label = e.label" if same_label else ""
    return (
        "vq AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), vs AS (SELECT q.vec_id::VARCHAR AS qid, e.vec_id::VARCHAR AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score "
        f"FROM embeddings e, vq q {cond}), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs), vh AS (SELECT * FROM vr WHERE rank <= {k})"
    )


def near(spark, sf_dir, same_label: bool) -> DataFrame:
    v = vectors_of(spark, sf_dir)
    q = v.where("cast(chunk_id AS bigint) % 100 = 0").select(F.col("chunk_id").alias("qid"), (F.col("corpus") if same_label else F.lit("")).alias("corpus"), "embedding")
    return vector.search(v, q)


@query(f"WITH {vector_sql(False)} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vh")
def vector_topk(spark, sf_dir):
    return out_hits(near(spark, sf_dir, False))


@query(f"WITH {vector_sql(True)} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vh")
def vector_topk_by_label(spark, sf_dir):
    return out_hits(near(spark, sf_dir, True))


@query(f"WITH {vector_sql(False)} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vh")
def vector_pruned(spark, sf_dir):
    """vector_topk over stored cells, of which those are read that can hold a hit."""
    v = vectors_of(spark, sf_dir)
    q = v.where("cast(chunk_id AS bigint) % 100 = 0").select(F.col("chunk_id").alias("qid"), F.lit("").alias("corpus"), "embedding")
    return out_hits(vector.nearest(vector.cluster(v), q))


_WEIGHTED = (
    "j AS (SELECT coalesce(h.qid, v.qid) AS qid, coalesce(h.chunk_id, v.chunk_id) AS chunk_id, coalesce(h.score, 0) AS b, coalesce(v.score, 0) AS v FROM hits h FULL JOIN vh v ON h.qid = v.qid AND h.chunk_id = v.chunk_id), "
    "m AS (SELECT *, max(b) OVER (PARTITION BY qid) AS mb, max(v) OVER (PARTITION BY qid) AS mv FROM j), f AS (SELECT qid, chunk_id, 0.6 * CASE WHEN mb > 0 THEN b / mb ELSE 0 END + 0.4 * CASE WHEN mv > 0 THEN v / mv ELSE 0 END AS score FROM m)"
)
_RRF = "f AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, chunk_id, rank FROM hits UNION ALL SELECT qid, chunk_id, rank FROM vh) GROUP BY ALL)"
_TOP = " SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f) WHERE rank <= 8"


@query(f"{bm25_sql()}, {vector_sql(False)}, {_WEIGHTED}{_TOP}")
def fuse_weighted(spark, sf_dir):
    hits = lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir))
    return out_hits(lexical.top_k(fusion.weighted(hits, near(spark, sf_dir, False)), 8))


@query(f"{bm25_sql()}, {vector_sql(False)}, {_RRF}{_TOP}")
def fuse_rrf(spark, sf_dir):
    hits = lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir))
    return out_hits(lexical.top_k(fusion.rrf(hits, near(spark, sf_dir, False)), 8))


@query(
    f"{bm25_sql()}, c2 AS (SELECT chunk_id, title, text, doc_title, corpus FROM c), {vector_sql(False)}, {_WEIGHTED}, p AS (SELECT f.qid, c2.*, score * least(1.0, length(trim(text)) / 80.0) AS s FROM f JOIN c2 USING (chunk_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM p), g AS (SELECT *, max(s) OVER (PARTITION BY qid) AS top FROM r WHERE rank <= 8) "
    "SELECT qid, rank, chunk_id, round(s, 6) AS score, corpus, doc_title, md5(CASE WHEN title <> '' THEN title ELSE 'document' END) AS section FROM g WHERE top >= 0.2"
)
def hybrid_retrieve(spark, sf_dir):
    """The flagship: BM25 and vectors fused, chunks joined, capped, cut and gated, for all queries at once."""
    return hybrid(spark, sf_dir)


def hybrid(spark, sf_dir, n: int | None = None) -> DataFrame:
    """hybrid_retrieve for all queries, or for the first n of them."""
    v = vectors_of(spark, sf_dir)
    q = v.where("cast(chunk_id AS bigint) % 100 = 0").select(F.col("chunk_id").alias("qid"), F.lit("").alias("corpus"), "embedding")
    ids = asked(spark, sf_dir).select("qid").union(q.select("qid")).distinct()
    if n is not None:
        ids = ids.orderBy(F.col("qid").cast("long")).limit(n)
        q = q.join(ids, "qid", "left_semi")
    queries = ids.join(asked(spark, sf_dir), "qid", "left").select("qid", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("corpus"))
    hits = retrieve.retrieve(index_of(spark, sf_dir), queries, retrieve.RetrieveParams(legal_rerank=False), q)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "corpus", "doc_title", F.md5("section").alias("section"))


def _passage(prompts: list[tuple[str, str]]) -> list[str]:
    """A generator with canned passages that differ by question, and none for some."""
    if len(prompts[0][1]) % 11 == 0:
        raise ValueError("no passage for this question")
    return [f"passage {len(p)}" for _, p in prompts]


def _passage_vectors(texts: list[str]) -> list[list[float]]:
    """Vectors of three dimensions for canned passages; other texts have none."""
    n = int(texts[0].removeprefix("passage "))
    return [[n % 5 - 2.0, n % 3 - 1.0, 1.0]]


_PROMPT_LENGTH = f"{len(generation.PASSAGE_PROMPT)} + length(trim(q))"


@query(
    f"{bm25_sql(k=20)}, t AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM hits), l AS (SELECT qid, chunk_id, score / best * least(1.0, length(trim(text)) / 80.0) * 0.7 AS score FROM t JOIN c USING (chunk_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM l), b AS (SELECT * FROM r WHERE rank <= 8), "
    f"w AS (SELECT qid, {_PROMPT_LENGTH} AS n FROM qs WHERE ({_PROMPT_LENGTH}) % 11 <> 0 AND qid IN (SELECT qid FROM b WHERE rank = 1 AND (qid::BIGINT % 300 = 0 OR score < 0.65) AND score > 0)), "
    "nr AS (SELECT qid, vec_id::VARCHAR AS chunk_id, list_cosine_similarity(embedding[:3]::DOUBLE[], [n % 5 - 2, n % 3 - 1, 1]::DOUBLE[]) AS score FROM embeddings, w), nk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM nr), "
    "f AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, chunk_id, rank FROM b WHERE qid IN (SELECT qid FROM w) UNION ALL SELECT qid, chunk_id, rank FROM nk WHERE rank <= 20) GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f) "
    "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM b WHERE qid NOT IN (SELECT qid FROM w) UNION ALL SELECT qid, chunk_id, round(score, 6), rank FROM fr WHERE rank <= 8"
)
def hyde_retrieve(spark, sf_dir):
    """A second pass for weak queries: their hits are fused with the neighbours of a generated passage; some passages fail. Every third query asks for one in any case."""
    at, q = index_of(spark, sf_dir), asked(spark, sf_dir)
    words = lexical.search(at, q)
    scored = retrieve.hydrate(fusion.weighted(words, words.where("false"), 0.7), at.chunks)
    ranked = lexical.top_k(scored.withColumn("score", fusion.length_penalty(F.col("score"), F.col("text"))), 8).select("qid", "chunk_id", "score", "rank")
    ranked = cut(ranked, "ranked")
    forced = F.when(F.col("qid").cast("long") % 300 == 0, "on").otherwise("auto")
    modes = q.select("qid", F.col("text").alias("generation_q"), "corpus", forced.alias("hyde"))
    found = retrieve.passages(modes, ranked.withColumn("variant", F.lit(0)), _passage, _passage_vectors, batch=1, vectors=1)
    return out_hits(retrieve.with_passages(at, ranked, found))


def _echo(prompts: list[tuple[str, str]]) -> list[str]:
    """A generator that answers with the question's length, rewrites with fixed lines, and fails for some questions."""
    out = []
    for system, prompt in prompts:
        question = prompt.split("\n")[0]
        if system and len(question) % 5 == 0:
            raise ValueError("no answer")
        out.append(f"{len(question)}" if system else "Requête 1 : les mots d'avant\nRequête 2 : xx")
    return out


@query(
    f"WITH {CHUNKS}, qs AS (SELECT conv_id || '-' || turn AS qid, coalesce(text, '') || [' rôle du président', ''][turn % 2 + 1] AS q FROM conversations WHERE turn < 2 AND trim(coalesce(text, '')) <> ''), "
    f"qe AS (SELECT qid, q, {TERMS.format('q')} AS terms FROM qs), v AS (SELECT qid, q, trim(q) || CASE WHEN strlen(trim(q)) < 200 AND NOT regexp_matches(q, '(?i)article\\s+(premier|\\d+)') AND list_has_any(terms, ["
    + ", ".join(f"'{w}'" for w in [*T.INSTITUTIONS, *T.ABSTRACT_INTENT])
    + f"]) THEN ' | les mots d''avant' ELSE '' END AS said FROM qe), tk AS (SELECT DISTINCT term FROM (SELECT unnest({TOK.format('text')}) AS term FROM c UNION ALL SELECT unnest({TOK.format('doc_title')}) FROM c UNION ALL SELECT unnest({TOK.format('title')}) FROM c UNION ALL SELECT 'document' FROM c WHERE title = '')), "
    f"h AS (SELECT DISTINCT qid FROM (SELECT qid, unnest({TOK.format('q')}) AS term FROM qs) JOIN tk USING (term)) "
    "SELECT qid, CASE WHEN h.qid IS NULL THEN 'no_results' WHEN length(string_split('Question: ' || q, chr(10))[1]) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN status = 'no_results' THEN 'Aucun résultat pertinent' ELSE '' END AS message, CASE WHEN status = 'ok' THEN length(string_split('Question: ' || q, chr(10))[1])::VARCHAR END AS answer, said AS rewrite_queries FROM v LEFT JOIN h USING (qid)"
)
def search_prompts(spark, sf_dir):
    """Answers of a canned generator for the first turns of conversations, over documents in a store; abstract questions are rewritten."""
    from .jobs.engine import Engine

    at, c = index_of(spark, sf_dir), table(spark, sf_dir, "conversations")
    more = F.when(F.col("turn") % 2 == 0, " rôle du président").otherwise("")
    q = c.where("turn < 2 AND trim(coalesce(text, '')) <> ''").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(F.coalesce("text", F.lit("")), more).alias("text"), F.lit("").alias("corpus"), F.lit("on").alias("rewrite"))
    store = Engine(spark, new_path(spark, "store"))
    store.index = lambda: at  # the index that the other queries read
    return store.search(q, _echo, replace(retrieve.RetrieveParams(), min_score=0.0), batch=1)


@query(
    f"{bm25_sql()}, v2 AS (SELECT qid, chunk_id, rank FROM hits WHERE rank <= 12 UNION ALL SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS rank FROM hits WHERE rank <= 5), f AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM v2 GROUP BY ALL){_TOP}"
)
def multi_query_rrf(spark, sf_dir):
    hits = lexical.search(index_of(spark, sf_dir), asked(spark, sf_dir)).select("qid", "chunk_id", "rank")
    w = Window.partitionBy("qid").orderBy("chunk_id")
    both = hits.where("rank <= 12").withColumn("variant", F.lit(0)).unionByName(hits.where("rank <= 5").select("qid", "chunk_id", F.row_number().over(w).alias("rank"), F.lit(1).alias("variant")))
    return out_hits(lexical.top_k(fusion.multi_query_rrf(both), 8))


@query("SELECT conv_id, turn, round(least(1.0, length(trim(coalesce(text, ''))) / 80.0), 6) AS score FROM conversations")
def length_penalty(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(fusion.length_penalty(F.lit(1.0), F.coalesce("text", F.lit(""))), 6).alias("score"))


_TURNS = "t AS (SELECT (conv_id % 10)::VARCHAR AS qid, conv_id::VARCHAR AS doc_id, conv_id || '-' || turn AS chunk_id, length(coalesce(text, '')) / 100.0::DOUBLE AS score FROM conversations)"


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 10).cast("string").alias("qid"), F.col("conv_id").cast("string").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), (F.length(F.coalesce("text", F.lit(""))) / F.lit(100.0)).alias("score"), F.col("turn").alias("position"))


_CAP = f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS n FROM t), k AS (SELECT * FROM n WHERE n <= 2)"


@query(_CAP + " SELECT qid, doc_id, chunk_id, score FROM k")
def dedupe_per_doc(spark, sf_dir):
    return fusion.cap_per_doc(turns(spark, sf_dir), 2).select("qid", "doc_id", "chunk_id", "score")


@query(_CAP + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM k), g AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM r WHERE rank <= 8) SELECT qid, chunk_id, score, rank FROM g WHERE top >= 12.0")
def min_score_gate(spark, sf_dir):
    rows = lexical.top_k(fusion.cap_per_doc(turns(spark, sf_dir), 2), 8)
    return retrieve.min_score_gate(rows, 12.0).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT lower(trim(coalesce(text, ''))) AS k, min(conv_id * 1000 + turn) AS first FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL")
def dedupe_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit(0).alias("qid"), F.coalesce("text", F.lit("")).alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return fusion.dedupe_queries(c, "qid", "text", "ord").select(F.lower(F.trim("text")).alias("k"), F.col("ord").alias("first"))


@query(f"WITH {_TURNS}, r AS (SELECT t.doc_id, t.qid AS corpus, c.turn, t.chunk_id FROM t JOIN conversations c ON t.chunk_id = c.conv_id || '-' || c.turn), n AS (SELECT 'q' || doc_id AS qid, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn, chunk_id) AS rank FROM r WHERE corpus::BIGINT % 2 = 0) SELECT qid, chunk_id, round(1.0 / rank, 6)::DOUBLE AS score FROM n WHERE rank <= 8")
def fallback_doc_chunks(spark, sf_dir):
    """A request for every document, in the corpus that it is in (even ones) or another."""
    rows = turns(spark, sf_dir).withColumnRenamed("qid", "corpus")
    odd = F.col("corpus").cast("long") % 2 == 1
    asked_for = rows.select("doc_id", F.concat(F.lit("q"), "doc_id").alias("qid"), F.when(odd, "none").otherwise(F.col("corpus")).alias("qcorpus")).distinct()
    return retrieve.fallback_chunks(rows, asked_for, 8).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("WITH r AS (SELECT conv_id::VARCHAR AS qid, conv_id || '-' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn) AS rank FROM conversations) SELECT qid, chunk_id, round(1.0 / rank, 6)::DOUBLE AS score FROM r WHERE rank <= 8")
def fallback_each_doc(spark, sf_dir):
    rows = turns(spark, sf_dir).drop("qid")
    return retrieve.fallback_chunks(rows, rows.select("doc_id", F.col("doc_id").alias("qid")).distinct(), 8).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def hydrate_and_delete(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return index.delete(d, lab.where("toxic = 1")).join(lab.select("doc_id", "quality").distinct(), "doc_id", "left")


@query("SELECT doc_id, 'old' AS of FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'new' FROM labels")
def upsert_union(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("of"))
    return index.upsert(old, table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("of")).distinct())


def _has(words) -> str:
    return "list_has_any(t, [" + ", ".join(f"'{w}'" for w in words) + "])"


def _in(articles) -> str:
    return "a IN (" + ", ".join(f"'{x}'" for x in articles) + ")"


@query(
    f"WITH q AS (SELECT doc_id, (doc_id % 17)::VARCHAR AS a, {TERMS.format('text || CASE doc_id % 5 WHEN 0 THEN ' + chr(39) + ' rôle du président' + chr(39) + ' WHEN 1 THEN ' + chr(39) + ' scrutin présidentielle' + chr(39) + ' WHEN 2 THEN ' + chr(39) + ' le peuple et le président' + chr(39) + ' WHEN 3 THEN ' + chr(39) + ' pleins pouvoirs urgence' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END')} AS t FROM documents) SELECT doc_id, round("
    + " + ".join(f"CASE WHEN {_has(w)} AND {_in(a)} THEN {b} ELSE 0 END" for w, a, b in T.AFFINITIES)
    + f" + CASE WHEN {_has(T.PRESIDENT)} AND {_has(T.RERANK_ABSTRACT)} AND NOT {_has(T.RERANK_ELECTION)} AND a = '5' THEN 0.45 ELSE 0 END + CASE WHEN {_has(T.PRESIDENT)} AND NOT {_has(T.RERANK_ELECTION)} AND {_in('56')} THEN 0.25 ELSE 0 END"
    f" + CASE WHEN {_has(['peuple'])} AND NOT {_has(T.PRESIDENT)} AND {_in('123')} THEN 0.2 ELSE 0 END, 6)::DOUBLE AS bonus, CASE WHEN {_has(['peuple'])} AND {_has(T.PRESIDENT)} AND {_in('123')} THEN 0.15 ELSE 0 END::DOUBLE AS penalty FROM q"
)
def legal_affinity(spark, sf_dir):
    more = F.element_at(F.array(*map(F.lit, (" rôle du président", " scrutin présidentielle", " le peuple et le président", " pleins pouvoirs urgence", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    q = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 17).cast("string").alias("a"), X.legal_terms(F.concat("text", more)).alias("t"))
    return q.select("doc_id", F.round(legal.affinity(F.col("t"), F.col("a")), 6).alias("bonus"), legal.penalty(F.col("t"), F.col("a")).alias("penalty"))


_DOC = "d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS text FROM documents)"
_STARTS = ("Paragraphe", "Section", "Chapitre", "Article", "Titre")


@query(
    f"WITH {_DOC}, s AS (SELECT doc_id, doc_id % 7 AS n, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{w} de '" for i, w in enumerate(_STARTS)) + " ELSE '' END || title AS title FROM d) "
    "SELECT doc_id, CASE " + " ".join(f"WHEN starts_with(lower(trim(title)), '{w.lower()}') THEN '{w} ' || (n + 1)" for w in ("Article", "Chapitre", "Section", "Paragraphe"))
    + " ELSE title END AS path, CASE n WHEN 1 THEN 'Titre' WHEN 2 THEN 'Chapitre' WHEN 3 THEN 'Section' WHEN 4 THEN 'Paragraphe' ELSE 'Article-' || n END AS prefix FROM s"
)
def section_paths(spark, sf_dir):
    start = F.element_at(F.array(*(F.lit(f"{w} de ") for w in _STARTS), F.lit("")), (F.col("doc_id") % 6 + 1).cast("int"))
    title = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    n = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select("doc_id", X.section_path(F.concat(start, title), n).alias("path"), X.heading_prefix(n).alias("prefix"))


@query(
    f"WITH {_DOC}, w AS (SELECT doc_id, {TERMS.format('array_to_string(list_slice(' + FIELDS_SQL.format('text') + ', 3, 8), ' + chr(39) + ' ' + chr(39) + ')')} AS q, "
    + FIELDS_SQL.format("regexp_replace(left(lower(title || ' ' || trim(text, ' ' || chr(9) || chr(13) || chr(10))), 400), '[^\\p{L}\\p{Nd}]', ' ', 'g')")
    + " AS w FROM d) SELECT doc_id, round(0.04::DOUBLE * len(list_filter(w, lambda x: list_contains(q, x))), 6) AS bonus FROM w"
)
def overlap_bonus(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    asked_for = X.legal_terms(F.array_join(F.slice(X.fields(text), 3, 6), " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(legal.overlap_bonus(asked_for, F.element_at(F.split(text, "\n"), 1), text), 6).alias("bonus"))


@query(_CAP + ", a AS (SELECT qid, min(doc_id) AS doc_id FROM t GROUP BY qid) SELECT qid, chunk_id, score FROM k JOIN a USING (qid, doc_id)")
def doc_filter_after_cap(spark, sf_dir):
    """Each query asks for one document; the cap per document comes first."""
    rows = turns(spark, sf_dir)
    asked_for = rows.groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    return fusion.cap_per_doc(rows, 2).join(lexical.local(asked_for), ["qid", "doc_id"], "left_semi").select("qid", "chunk_id", "score")


@query(
    f"{bm25_sql()}, a AS (SELECT chunk_id, (chunk_id::BIGINT % 17)::VARCHAR AS article FROM c), top AS (SELECT qid, max(score) AS top FROM hits GROUP BY qid), "
    "r AS (SELECT qid, unnest([(qid::BIGINT // 100 % 17)::VARCHAR, ((qid::BIGINT // 100 + 3) % 17)::VARCHAR]) AS article FROM qs) "
    "SELECT qid, chunk_id, round(score, 6) AS score FROM hits UNION ALL "
    "SELECT r.qid, a.chunk_id, round(0.95::DOUBLE * coalesce(top, 1 / 0.95::DOUBLE), 6) FROM r JOIN a USING (article) LEFT JOIN top USING (qid) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = r.qid AND h.chunk_id = a.chunk_id)"
)
def article_boost(spark, sf_dir):
    at, q = index_of(spark, sf_dir), asked(spark, sf_dir)
    n = F.floor(F.col("qid").cast("long") / 100)
    named = q.select("qid", "corpus", F.format_string("article %d et article %d", n % 17, (n + 3) % 17).alias("text"))
    chunks = at.chunks.withColumn("article", (F.col("chunk_id").cast("long") % 17).cast("string"))
    return legal.boost_articles(lexical.search(at, q), named, chunks).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def _expansion_sql(q: str, t: str) -> str:
    """List of q and its variants; t: its terms."""
    any_of = lambda words: f"list_has_any({t}, [" + ", ".join(f"'{w}'" for w in words) + "])"
    president, abstract, election, emergency = any_of(T.PRESIDENT), any_of(T.ABSTRACT_INTENT), any_of(T.ELECTION), any_of(T.EMERGENCY)
    rules = {
        "article_one": f"({any_of(['premier'])} OR contains(lower({q}), 'article 1') OR contains(lower({q}), 'article premier')) AND {any_of(['republique', 'republic'])}",
        "president_role": f"{president} AND {abstract} AND NOT {election}", "president_election": f"{president} AND {election}", "emergency": emergency,
        "emergency_election": f"{emergency} AND ({president} OR {election})", "parliament": f"{any_of(['parlement'])} AND {abstract}", "government": f"{any_of(['gouvernement'])} AND {abstract}",
    }
    more = ", ".join(f"CASE WHEN {cond} THEN {q} || ' {T.EXPANSIONS[name]}' END" for name, cond in rules.items())
    return f"CASE WHEN {q} = '' THEN [] ELSE list_filter([{q}, {more}], lambda x: x IS NOT NULL) END"


_MORE = (" rôle du président", " scrutin du président", " urgence et scrutin", " rôle du parlement", "")
_MORE_SQL = "trim(coalesce(text, '') || [" + ", ".join(f"'{m}'" for m in _MORE) + "][conv_id % 5 + 1])"


def _more(text: str = "text"):
    return F.concat(F.coalesce(text, F.lit("")), F.element_at(F.array(*map(F.lit, _MORE)), (F.col("conv_id") % 5 + 1).cast("int")))


@query(f"WITH q AS (SELECT conv_id, turn, {_MORE_SQL} AS q FROM conversations), t AS (SELECT *, {TERMS.format('q')} AS t FROM q), x AS (SELECT conv_id, turn, {_expansion_sql('q', 't')} AS x FROM t) SELECT conv_id, turn, unnest(generate_series(0, len(x) - 1))::INT AS variant, unnest(x) AS text FROM x")
def query_expansion(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(legal.expansions(_more())).alias("variant", "text"))


@query(
    f"WITH q AS (SELECT conv_id || '-' || turn AS qid, {_MORE_SQL} AS g, CASE WHEN turn % 3 = 2 THEN trim(coalesce(text, '')) ELSE '' END AS r, turn % 2 = 0 AS legal, turn FROM conversations), t AS (SELECT *, {TERMS.format('g')} AS t FROM q), "
    f"x AS (SELECT qid, CASE WHEN r <> '' THEN [r] WHEN legal THEN {_expansion_sql('g', 't')} ELSE [g] END || CASE WHEN r = '' AND turn % 4 = 1 AND is_abstract THEN ['Un autre texte', 'encore un'] ELSE [] END AS x FROM (SELECT *, g <> '' AND strlen(g) < 200 AND NOT regexp_matches(g, '(?i)article\\s+(premier|\\d+)') AND (list_has_any(t, ["
    + ", ".join(f"'{w}'" for w in [*T.INSTITUTIONS, *T.ABSTRACT_INTENT])
    + "])) AS is_abstract FROM t)), u AS (SELECT qid, unnest(generate_series(0, len(x) - 1)) AS o, trim(unnest(x)) AS text FROM x), d AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(text) ORDER BY o) AS n FROM u WHERE text <> '') "
    "SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY o) - 1)::INT AS variant, text FROM d WHERE n = 1"
)
def build_queries(spark, sf_dir):
    """What is searched for: a retrieval text alone, or the question, its rule-made variants and a model's lines."""
    c = table(spark, sf_dir, "conversations").withColumn("qid", F.concat_ws("-", "conv_id", "turn"))
    asked_for = c.select("qid", _more().alias("generation_q"), F.when(F.col("turn") % 3 == 2, F.col("text")).alias("retrieval_q"), F.when(F.col("turn") % 2 == 0, "legal-demo").otherwise("web").alias("corpus"))
    raw = c.where("turn % 4 = 1").select("qid", F.lit("Requête 1 : Un autre texte\nRequête 2: UN AUTRE TEXTE\nabc\nencore un").alias("raw"))
    return retrieve.build_queries(asked_for, raw).select("qid", "variant", "text")


@query(
    f"WITH s AS (SELECT doc_id, trim(unnest(string_split(text, '. '))) AS s, list_distinct(list_slice({SNIP.format('text')}, 1, 5)) AS q FROM documents), x AS (SELECT doc_id, len(list_filter({SNIP.format('s')}, lambda w: list_contains(q, w))) + "
    + " + ".join(f"contains(lower(s), '{t}')::INT" for t in T.PRIORITY_TERMS)
    + " AS score FROM s WHERE s <> '' AND NOT regexp_matches(s, '(?i)^ARTICLE\\s+(?:PREMIER|\\d+)\\.?\\s*$')) SELECT doc_id, count(*) AS sentences, sum(score)::BIGINT AS total, max(score)::BIGINT AS best FROM x GROUP BY ALL"
)
def sentence_scores(spark, sf_dir):
    q = F.array_distinct(F.slice(X.snippet_tokens(F.col("text")), 1, 5))
    of = lambda x: F.struct(F.size(x).cast("long").alias("sentences"), F.aggregate(x, F.lit(0), lambda a, v: a + v["score"]).cast("long").alias("total"), F.array_max(F.transform(x, lambda v: v["score"])).cast("long").alias("best"))
    scored = X.let(q, lambda t: excerpt.scored_sentences(F.col("text"), t))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.inline(X.let(scored, lambda x: F.when(F.size(x) > 0, F.array(of(x))))))  # scored once a text: a filter would score it again


@query("WITH u AS (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) SELECT conv_id, turn, used FROM u WHERE used <= 1500")
def prompt_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return excerpt.within_budget(c, "conv_id", "turn", "text", 1500).select("conv_id", "turn", "used")


@query()
def excerpts(spark, sf_dir):
    at, q = index_of(spark, sf_dir), asked(spark, sf_dir)
    hits = retrieve.retrieve(at, q)
    return excerpt.with_excerpts(hits, at.chunks, q).select("qid", "rank", "chunk_id", "excerpt")


@query("SELECT CASE WHEN grouping(lang) = 1 THEN NULL WHEN coalesce(lang, '') = '' THEN '_default' ELSE lang END AS corpus, count(*) AS documents, count(*) AS chunks, count(v.vec_id) AS embedded, count(*) FILTER (v.vec_id IS NULL) AS failures, arg_max(d.doc_id, d.doc_id % 1000 * 1000000 + d.doc_id)::VARCHAR AS last_document, max(d.doc_id % 1000) AS last_at FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id GROUP BY ROLLUP (lang)")
def ingest_stats_rollup(spark, sf_dir):
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id")
    rows = d.join(v, d.doc_id == v.vec_id, "left").select(F.lit("ingest").alias("event"), "doc_id", F.col("lang").alias("corpus"), F.lit(1).alias("chunks"), F.col("vec_id").isNotNull().cast("int").alias("embedded"), F.col("vec_id").isNull().cast("int").alias("failed"), F.timestamp_seconds(F.col("doc_id") % 1000).alias("at"))
    return stats.totals(rows).withColumn("last_at", F.unix_timestamp("last_at"))


@query(f"{bm25_sql(k=8)}, r AS (SELECT qs.qid, min(CASE WHEN h.chunk_id = qs.qid THEN h.rank END) AS r FROM qs LEFT JOIN hits h ON h.qid = qs.qid GROUP BY ALL) SELECT count(*) AS cases, round(avg((r IS NOT NULL)::INT), 6) AS recall_at_k, round(avg(CASE WHEN r IS NULL THEN 0 ELSE 1.0::DOUBLE / r END), 6) AS mrr FROM r")
def eval_recall_mrr(spark, sf_dir):
    q = asked(spark, sf_dir)
    gold = q.select(F.col("qid").alias("id"), F.array().cast("array<string>").alias("expected_chunk_ids"), F.array("qid").alias("expected_doc_ids"), F.array().cast("array<string>").alias("expected_sections"), F.lit(False).alias("match_all_sections"), F.lit(False).alias("expect_no_results"))
    hits = lexical.search(index_of(spark, sf_dir), q, 8).select("qid", "chunk_id", F.col("chunk_id").alias("doc_id"), "rank", F.lit("").alias("section"), F.lit("").alias("article"))
    return evalkit.report(evalkit.per_case(hits, gold)).select("cases", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from .streaming.ingest import event_windows as windows

    return windows(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# --- the store, the embedder, filters, prompts and evaluation


@query("SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN '' WHEN 2 THEN 'legal' END AS corpus, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents WHERE doc_id % 10 <> 3 AND doc_id IS NOT NULL")
def store_roundtrip(spark, sf_dir):
    """Documents stored in two commits, the second replacing some of the first, and some deleted; corpora look like numbers, are empty or null."""
    from .jobs.engine import Engine

    d = table(spark, sf_dir, "documents")
    corpus = F.when(F.col("doc_id") % 4 == 0, "2024").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "legal")
    empty = {k: F.lit("") for k in ("original_content", "book_title", "article")}
    d = d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.lit("markdown").alias("content_type"), corpus.alias("corpus")).withColumns(empty)
    store = Engine(spark, new_path(spark, "store"))
    store.ingest(d.where("cast(id AS bigint) % 3 = 0").withColumn("content", F.lit("an older text")))
    store.ingest(d)
    store.delete([r.id for r in d.where("cast(id AS bigint) % 10 = 3").select("id").collect()])  # a caller's list of ids
    return store.documents().select("doc_id", "corpus", F.length("content").cast("long").alias("n_chars"))


def _sizes(texts: list[str]) -> list[list[float]]:
    """An embedder that fails for some texts."""
    if len(texts[0]) % 7 == 0:
        raise ValueError("no vector for this text")
    return [[float(len(t)), 1.0] for t in texts]


@query("SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN length(text)::DOUBLE END AS size, coalesce(length(text) % 7 = 0 AND text <> '', false) AS embed_failed FROM documents")
def embed_failures(spark, sf_dir):
    rows = embedding.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), _sizes, batch=1)
    return rows.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("size"), "embed_failed")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 17)::VARCHAR ELSE '' END AS article, CASE WHEN doc_id % 40 = 7 THEN 'Article Premier' ELSE 'Article ' || (doc_id % 20) || '. x' END AS title FROM documents) WHERE article = '1' OR regexp_matches(upper(title), 'ARTICLE 1([^0-9]|$)') OR contains(upper(title), 'ARTICLE PREMIER')")
def retrieve_article_filter(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 == 0, (n % 17).cast("string")).otherwise("").alias("article"), F.when(n % 40 == 7, "Article Premier").otherwise(F.concat(F.lit("Article "), (n % 20).cast("string"), F.lit(". x"))).alias("title"))
    return retrieve.filter_by_article(rows, "1").select("doc_id")


_SHOWN = "h AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '16' WHEN 1 THEN '7' ELSE '' END AS article, CASE WHEN conv_id % 2 = 0 THEN coalesce(text, '') || ' DISSOUTE' ELSE coalesce(text, '') END AS excerpt FROM conversations)"


@query(f"WITH {_SHOWN}, b AS (SELECT conv_id, bool_or(article = '16' AND contains(lower(excerpt), 'dissoute')) AS a16, bool_or(article = '7') AS a7 FROM h GROUP BY conv_id) SELECT conv_id AS qid, CASE WHEN a16 OR a7 THEN '{T.CHECK_HEAD}' || CASE WHEN a16 THEN '{T.CHECK_16.replace(chr(39), chr(39) * 2)}' ELSE '' END || CASE WHEN a7 THEN '{T.CHECK_7.replace(chr(39), chr(39) * 2)}' ELSE '' END ELSE '' END AS checklist FROM b")
def prompt_checklist(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    article = F.when(F.col("turn") % 3 == 0, "16").when(F.col("turn") % 3 == 1, "7").otherwise("")
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), article.alias("article"), F.when(F.col("conv_id") % 2 == 0, F.concat(text, F.lit(" DISSOUTE"))).otherwise(text).alias("excerpt"))
    return excerpt.checklist(hits)


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(answer), '{p}')" for p in T.REFUSALS) + " AS refusal FROM (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' The excerpts DO NOT contain it.' WHEN 1 THEN ' Aucune information.' ELSE '' END AS answer FROM conversations)")
def refusal_flags(spark, sf_dir):
    more = F.when(F.col("turn") % 3 == 0, " The excerpts DO NOT contain it.").when(F.col("turn") % 3 == 1, " Aucune information.").otherwise("")
    return evalkit.refusals(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("answer"))).drop("answer")


_FIRST_WORDS = "list_slice(" + FIELDS_SQL.format("coalesce(text, '')") + ", 1, 2)"


@query(
    f"WITH c AS (SELECT *, coalesce(text, '') AS x FROM conversations), g AS (SELECT conv_id, upper(role) AS want, {_FIRST_WORDS} AS terms FROM c WHERE turn = 1), h AS (SELECT g.conv_id, want, terms, c.x, row_number() OVER (PARTITION BY g.conv_id ORDER BY c.turn) AS n FROM g JOIN c ON c.conv_id = g.conv_id AND contains(upper(c.role), want)) "
    "SELECT conv_id AS id, want AS section, len(list_filter(terms, lambda w: NOT contains(lower(x), lower(w)))) = 0 AS passed FROM h WHERE n = 1"
)
def eval_excerpts(spark, sf_dir):
    """Cases: the section is the role of a conversation's second turn, the terms its first words; they must be in the first turn of that role."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    gold = c.where("turn = 1").select(F.col("conv_id").alias("id"), F.create_map(F.upper("role"), F.slice(X.fields(F.col("text")), 1, 2)).alias("excerpt_terms_by_section"))
    hits = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("role").alias("section"), F.lit("").alias("article"), F.col("text").alias("excerpt"))
    return evalkit.excerpt_cases(hits, gold)


@query(f"WITH c AS (SELECT *, coalesce(text, '') AS x FROM conversations), a AS (SELECT conv_id, string_agg(x, ' ' ORDER BY turn) AS answer FROM c WHERE turn % 2 = 1 GROUP BY conv_id), g AS (SELECT conv_id, {_FIRST_WORDS} AS phrases FROM c WHERE turn = 0) SELECT g.conv_id AS id, len(list_filter(phrases, lambda w: NOT contains(lower(coalesce(answer, '')), lower(w)))) = 0 AS passed FROM g LEFT JOIN a USING (conv_id) WHERE len(phrases) > 0")
def eval_phrases(spark, sf_dir):
    """Cases: the first words of a conversation must be in what its odd turns say together."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    gold = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.slice(X.fields(F.col("text")), 1, 2).alias("generation_phrases"))
    return evalkit.phrase_cases(c.where("turn % 2 = 1").groupBy(F.col("conv_id").alias("id")).agg(said.alias("answer")), gold)
