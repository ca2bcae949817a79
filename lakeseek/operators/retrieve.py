"""The retrieval pipeline, for a table of queries at once."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import embedding, fusion, generation, legal, lexical, vector
from .index import Index
from .lexical import top_k


#: Hits up to which they are held, not written.
FEW_HITS = 20_000
_YES, _NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def _number(raw: str | None) -> float | None:
    try:
        x = float(raw or "")
    except ValueError:
        return None
    return x if math.isfinite(x) else None


@dataclass(frozen=True)
class RetrieveParams:
    bm25_k: int = 20
    vector_k: int = 20
    top_k: int = 8
    min_score: float = 0.2
    weight: float = 0.6
    fusion: str = "weighted"
    max_per_doc: int | None = None
    legal_rerank: bool | None = None
    doc_id: str = ""
    article: str = ""
    #: Hits that default_cap() counts with, where a variant is ranked deeper than the result.
    cap_k: int | None = None

    @classmethod
    def of(cls, params: dict[str, str | None]) -> RetrieveParams:
        """Parameters as texts, as a request brings them: unknown ones and values that can't be read are the defaults'.

        fusion is a mode (rrf) or the weight of the words' score.
        """
        got = {k: v.strip() for k, v in params.items() if v and v.strip()}
        out: dict = {k: got[k] for k in ("doc_id", "article") if k in got}
        for k in ("bm25_k", "vector_k", "top_k", "max_per_doc"):
            if re.fullmatch(r"\+?[0-9]{1,9}", got.get(k, "")) and int(got[k]) > 0:
                out[k] = int(got[k])
        if (least := _number(got.get("min_score"))) is not None:
            out["min_score"] = least
        if got.get("fusion", "").lower() == "rrf":
            out["fusion"] = "rrf"
        elif (w := _number(got.get("fusion"))) is not None and 0 <= w <= 1:
            out["weight"] = w
        if (low := got.get("legal_rerank", "").lower()) in _YES | _NO:
            out["legal_rerank"] = low in _YES
        return cls(**out)

    def __post_init__(self):
        if self.fusion not in ("weighted", "rrf") or min(self.bm25_k, self.vector_k, self.top_k) < 1 or not 0 <= self.weight <= 1:
            raise ValueError("bad retrieval parameters")


def default_cap(p: RetrieveParams):
    """Hits of a document at most: 8 where one is asked for, up to 6 in a corpus, else 1."""
    if p.max_per_doc is not None:
        return F.lit(p.max_per_doc)
    if p.doc_id:
        return F.lit(8)
    return F.when(F.col("qcorpus") != "", F.lit(min(p.cap_k or p.top_k, 6))).otherwise(F.lit(1))


def hydrate(hits: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Hits with their chunk's columns; hits of unknown chunks go.

    Hits are made once: written, or held where the caller knows that they are few. Few of
    them meet the chunks as the small side, and very few are pushed down to the chunks'
    files, which the store sorts by chunk_id.
    """
    rows = lexical.held(hits) if few else None
    if rows is None:
        hits = cut(hits, "hits")
        rows = lexical.held(hits)
    if rows is None:
        return chunks.join(hits, "chunk_id")
    ids = rows["chunk_id"].unique().to_pylist()
    if len(ids) <= lexical.PUSHED:
        chunks = chunks.where(F.col("chunk_id").isin(ids))
    return chunks.join(F.broadcast(hits.sparkSession.createDataFrame(rows, hits.schema)), "chunk_id")


def fallback_chunks(chunks: DataFrame, requests: DataFrame, k: int, by: str = "position") -> DataFrame:
    """requests (qid, doc_id and, if any, qcorpus) -> the first k chunks of each one's document, scored 1 / place."""
    w = Window.partitionBy("qid").orderBy(by, "chunk_id")
    rows = chunks.join(lexical.local(requests), "doc_id")
    rows = rows.where("qcorpus = '' OR qcorpus = corpus") if "qcorpus" in requests.columns else rows
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.withColumn("score", 1.0 / F.col("rank"))


def filter_by_article(hits: DataFrame, article: str) -> DataFrame:
    """Hits of the article, by its number or, where a chunk has none that fits, by 'ARTICLE n' in its title: the whole number, so 1 isn't 16."""
    want = article.strip().upper()
    if not want:
        return hits
    named = F.upper(F.coalesce("title", F.lit(""))).rlike(r"ARTICLE \Q" + want + r"\E(?![0-9])" + ("|ARTICLE PREMIER" if want == "1" else ""))
    return hits.where((F.upper(F.coalesce("article", F.lit(""))) == want) | named)


def without_hits(queries: DataFrame, hits: DataFrame, doc_id: str) -> DataFrame:
    """(qid, qcorpus, doc_id) of queries that have no hit."""
    asked = queries.select("qid", F.coalesce("corpus", F.lit("")).alias("qcorpus"), F.lit(doc_id).alias("doc_id")).distinct()
    return asked.join(hits.select("qid").distinct(), "qid", "left_anti")


def min_score_gate(hits: DataFrame, least: float) -> DataFrame:
    """All hits of a query, or none if its best is below the least."""
    return hits.withColumn("__top", F.max("score").over(Window.partitionBy("qid"))).where(F.col("__top") >= least).drop("__top")


def candidates(index: Index, queries: DataFrame, p: RetrieveParams, query_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score): lexical hits, fused with vector hits where the index and the queries have vectors."""
    words = lexical.search(index, queries, p.bm25_k)
    if index.vectors is None or query_vectors is None:
        return fusion.weighted(words, words.where("false"), 1.0) if p.fusion == "weighted" else fusion.rrf(words)
    near = vector.search(index.vectors, query_vectors, p.vector_k)
    return fusion.weighted(words, near, p.weight) if p.fusion == "weighted" else fusion.rrf(words, near)


def retrieve(index: Index, queries: DataFrame, p: RetrieveParams = RetrieveParams(), query_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, text, corpus) -> hits (qid, rank, chunk_id, doc_id, score, corpus, section, doc_title, section_path, article).

    Lists are fused by id, then joined to chunks; short texts weigh less; articles named
    together are added; legal hits reranked. The cap per document comes before the
    filters by document and article, the limit after them, and the gate last, on the
    best score. A query without hits has no row, or the first chunks of the document
    where one is asked for. In rrf mode scores are of another order, so the gate is off
    there. Ranking is one job, whose rows are written or, if few, held; what follows reads
    them.
    """
    queries = queries.select("qid", "text", "corpus")
    known = lexical.held(queries)
    if known is not None:
        queries = F.broadcast(queries.sparkSession.createDataFrame(known, queries.schema))
    few = known is not None and known.num_rows * (p.bm25_k + p.vector_k) <= FEW_HITS
    q = queries.select("qid", F.col("text").alias("query"), F.coalesce("corpus", F.lit("")).alias("qcorpus"))
    fused = candidates(index, queries, p, query_vectors)
    fused = legal.boost_articles(fused, queries, index.chunks)
    rows = hydrate(fused, index.chunks, few).join(q, "qid")
    if p.fusion == "weighted":
        rows = rows.withColumn("score", fusion.length_penalty(F.col("score"), F.col("text")))
    rows = legal.rerank(rows, p.legal_rerank)
    rows = fusion.cap_per_doc(rows, default_cap(p))
    if p.doc_id:
        rows = rows.where(F.col("doc_id") == p.doc_id)
    rows = top_k(filter_by_article(rows, p.article), p.top_k)
    if p.fusion == "weighted" and p.min_score > 0:
        rows = min_score_gate(rows, p.min_score)
    if p.doc_id:
        columns = ["qid", "rank", "score", *index.chunks.columns]
        rows = cut(rows.select(columns), "ranked")
        rows = rows.unionByName(fallback_chunks(index.chunks, without_hits(queries, rows, p.doc_id), p.top_k).select(columns))
    section = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("section_path"))
    return rows.select("qid", "rank", "chunk_id", "doc_id", "score", "corpus", section.alias("section"), "doc_title", "section_path", "article")


def build_queries(queries: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """(qid, generation_q, retrieval_q, corpus) -> (qid, variant, text, corpus): what is searched for.

    A retrieval text stands alone. Else the question, expanded by rule in legal corpora,
    and the lines of a model's answer (rewrites: qid, raw) for abstract questions; all
    distinct but for case, blank ones out, in this order.
    """
    rows = queries.select("qid", F.trim(F.coalesce("generation_q", F.lit(""))).alias("g"), F.trim(F.coalesce("retrieval_q", F.lit(""))).alias("r"), F.coalesce("corpus", F.lit("")).alias("corpus"))
    rows = rows.join(rewrites.select("qid", "raw"), "qid", "left") if rewrites is not None else rows.withColumn("raw", F.lit(None).cast("string"))
    own = F.when(legal.is_legal(F.col("corpus")), legal.expansions(F.col("g"))).otherwise(F.array("g"))
    more = F.when(F.col("raw").isNotNull() & legal.is_abstract(F.col("g")), legal.parse_rewrites(F.col("raw"))).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.col("r") != "", F.array("r")).otherwise(F.concat(own, more))
    rows = rows.select("qid", F.posexplode(texts).alias("o", "text"), "corpus")
    rows = fusion.dedupe_queries(rows.withColumn("text", F.trim("text")), "qid", "text", "o")
    return rows.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("o")) - 1).alias("variant"), "text", "corpus")


def excerpt_queries(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """(qid, text): what excerpts are chosen by: the retrieval text, else all variants joined; '' without either."""
    joined = variants.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "text"))), lambda x: x["text"]), " ").alias("all"))
    own = F.trim(F.coalesce("retrieval_q", F.lit("")))
    return queries.join(joined, "qid", "left").select("qid", F.when(own != "", F.col("retrieval_q")).otherwise(F.coalesce("all", F.lit(""))).alias("text"))


def ranked_variants(index: Index, variants: DataFrame, p: RetrieveParams = RetrieveParams(), query_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, variant, text, corpus) -> (qid, variant, chunk_id, rank, score): each variant ranked and gated on its own, 12 hits or more. Written once.

    query_vectors: (qid, variant, corpus, embedding), if any.
    """
    own = F.concat_ws("\u0001", F.col("qid").cast("string"), F.col("variant").cast("string"))
    keys = variants.select(own.alias("qid"), "text", "corpus")
    wide = replace(p, top_k=max(p.top_k, 12), cap_k=p.top_k)
    hits = retrieve(index, keys, wide, None if query_vectors is None else query_vectors.select(own.alias("qid"), "corpus", "embedding"))
    back = variants.select(own.alias("k"), F.col("qid").alias("of"), "variant")
    return cut(hits.join(lexical.local(back), F.col("qid") == F.col("k")).select(F.col("of").alias("qid"), "variant", "chunk_id", "rank", "score"), "variants")


def fuse_variants(index: Index, rows: DataFrame, variants: DataFrame, p: RetrieveParams = RetrieveParams()) -> DataFrame:
    """Ranked variants -> (qid, chunk_id, score, rank).

    Of a query with one variant these are its hits and scores; several are fused by rank,
    and gated on variant 0's best score. A query without hits has the first chunks of
    the document where one is asked for.
    """
    lone = variants.groupBy("qid").agg(F.count("*").alias("n")).where("n = 1").select("qid")
    single = rows.join(lone, "qid", "left_semi").where(F.col("rank") <= p.top_k).select("qid", "chunk_id", "score", "rank")
    good = rows.where("variant = 0").groupBy("qid").agg(F.max("score").alias("top")).where(F.col("top") >= p.min_score).select("qid")
    several = rows.join(lone, "qid", "left_anti").join(good, "qid", "left_semi")
    hits = cut(single.unionByName(top_k(fusion.multi_query_rrf(several), p.top_k).select(single.columns)), "fused")
    if p.doc_id:
        more = fallback_chunks(index.chunks, without_hits(variants.where("variant = 0"), hits, p.doc_id), p.top_k)
        hits = hits.unionByName(more.select(hits.columns))
    return hits


def retrieve_variants(index: Index, variants: DataFrame, p: RetrieveParams = RetrieveParams(), query_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, variant, text, corpus) -> (qid, chunk_id, score, rank): each variant ranked, then fused."""
    return fuse_variants(index, ranked_variants(index, variants, p, query_vectors), variants, p)


def rewritten(queries: DataFrame, generate: generation.Generator, **how) -> DataFrame:
    """(qid, raw): a generator's rewrites of the queries that may have some: abstract ones without a retrieval text, where rewrite or the corpus says so. Those that fail have none.

    queries: qid, generation_q, retrieval_q, corpus and, if any, rewrite.
    """
    raw = F.col("rewrite") if "rewrite" in queries.columns else F.lit("")
    some = queries.where((F.trim(F.coalesce("retrieval_q", F.lit(""))) == "") & generation.wants_rewrites(raw, F.col("corpus")) & legal.is_abstract(F.coalesce("generation_q", F.lit(""))))
    prompt = F.concat(F.lit(generation.REWRITE_PROMPT), F.trim("generation_q"))
    return cut(generation.generate(some.select("qid", "generation_q"), generate, prompt, **how).where("generated IS NOT NULL").select("qid", F.col("generated").alias("raw")), "rewrites")


def passages(queries: DataFrame, rows: DataFrame, generate: generation.Generator, embed: embedding.Embedder, vectors: int = embedding.BATCH, **how) -> DataFrame:
    """(qid, corpus, embedding): a generated passage's vector for each query that wants one, by its mode and variant 0's best score in rows.

    queries: qid, generation_q, corpus, hyde (on, auto or off). Only these queries go
    through the generator and the embedder, once; where either fails there is no row.
    vectors: texts that the embedder gets at once.
    """
    top = rows.where("variant = 0").groupBy("qid").agg(F.max("score").alias("top"))
    weak = queries.join(top, "qid").where(generation.wants_passage(F.col("hyde"), F.col("top")))
    prompt = F.concat(F.lit(generation.PASSAGE_PROMPT), F.trim(F.coalesce("generation_q", F.lit(""))))
    told = generation.generate(weak.select("qid", "generation_q", F.coalesce("corpus", F.lit("")).alias("corpus")), generate, prompt, **how)
    told = embedding.embed(told.where("generated IS NOT NULL"), embed, "generated", vectors)
    return cut(told.where("embedding IS NOT NULL").select("qid", "corpus", "embedding"), "passages")


def with_passages(index: Index, hits: DataFrame, passages: DataFrame, p: RetrieveParams = RetrieveParams()) -> DataFrame:
    """Hits (qid, chunk_id, score, rank) of queries that have a passage, fused by rank with its neighbours; those of the others, and of passages without neighbours, as they are. A query without hits gets none by a passage."""
    asked = passages.join(hits.select("qid").distinct(), "qid", "left_semi")
    near = cut(vector.search(index.vectors, asked, p.vector_k), "neighbours")
    helped = near.select("qid").distinct()
    boosted = hyde_boost(hits.join(helped, "qid", "left_semi"), near, p.top_k)
    return hits.join(helped, "qid", "left_anti").select("qid", "chunk_id", "score", "rank").unionByName(boosted.select("qid", "chunk_id", "score", "rank"))


def shown(index: Index, hits: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, rank) with the chunks' columns, as retrieve() gives them."""
    section = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("section_path"))
    return hydrate(hits, index.chunks).select("qid", "rank", "chunk_id", "doc_id", "score", "corpus", section.alias("section"), "doc_title", "section_path", "article")


def pipeline(index: Index, queries: DataFrame, p: RetrieveParams = RetrieveParams(), generate: generation.Generator | None = None, embed: embedding.Embedder | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(hits, variants) of queries (qid, generation_q, retrieval_q, corpus and, if any, hyde, rewrite).

    What is searched for is built first (a retrieval text alone, or the question, its
    rule-made variants and the generator's rewrites), then ranked, fused, and a second
    pass goes over the queries whose best hit is weak: a generated passage's neighbours
    are fused with their hits. hyde is auto in the corpus legal-demo and off elsewhere,
    where the queries don't say. how: batch and seconds of the generator. A generator or
    embedder that fails costs what it would have added, never a query.
    """
    hyde = F.col("hyde") if "hyde" in queries.columns else F.lit(None).cast("string")
    queries = cut(queries.withColumn("hyde", F.coalesce(hyde, F.when(F.col("corpus") == "legal-demo", "auto").otherwise("off"))), "asked")
    variants = cut(build_queries(queries, None if generate is None else rewritten(queries, generate, **how)), "queries")
    vectors = embedding.embed(variants, embed).where("embedding IS NOT NULL").select("qid", "variant", "corpus", "embedding") if embed and index.vectors is not None else None
    rows = ranked_variants(index, variants, p, vectors)
    hits = fuse_variants(index, rows, variants, p)
    if generate is not None and embed is not None and index.vectors is not None:
        found = passages(queries, rows, generate, embed, **how)
        if not found.isEmpty():
            hits = with_passages(index, hits, found, p)
    return shown(index, hits), variants


def hyde_boost(hits: DataFrame, passage_hits: DataFrame, k: int) -> DataFrame:
    """Current ranks and those of a generated passage's neighbours by RRF; scores become RRF scores."""
    return top_k(fusion.rrf(hits, passage_hits), k)


def wants_hyde(top: float, forced: bool = False) -> bool:
    """generation.wants_passage() for one query."""
    return forced or 0 < top < generation.CONFIDENCE
