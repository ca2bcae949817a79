"""Chunking: one document -> many rows."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import markup
from ..functions import text as X
from ..functions import terms as T


@dataclass(frozen=True)
class ChunkConfig:
    max_words: int = 600
    overlap: int = 60
    min_bytes: int = 80

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_words:
            raise ValueError("overlap must be less than max_words")


def token_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, position, text): windows of max_words words, each starting max_words - overlap after the one before."""
    step = cfg.max_words - cfg.overlap
    rows = docs.select(F.col(id_col), X.fields(F.coalesce(F.col(text), F.lit(""))).alias("w")).where("size(w) > 0")
    at = F.expr(f"transform(sequence(0, greatest(0, cast(ceil((size(w) - {cfg.max_words}) / {step}D) AS int))), i -> array_join(slice(w, i * {step} + 1, {cfg.max_words}), ' '))")
    return rows.select(id_col, F.posexplode(at).alias("position", "text"))


def neighbor_context(sections: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """sections with column context: the last sentence of the one before and the first of the one after around the text, behind their marks."""
    w = Window.partitionBy(by).orderBy(order)
    return sections.withColumn("context", in_context(F.col(text), F.lag(text).over(w), F.lead(text).over(w)))


def in_context(text: Column, previous: Column, following: Column) -> Column:
    """text with the last sentence of the one before and the first of the one after around it, behind their marks; nulls have none."""
    before, after = X.boundary_sentence(previous, True), X.boundary_sentence(following, False)
    out = F.when(before != "", F.concat(F.lit(T.CONTEXT_BEFORE + " "), before, F.lit(".\n\n"))).otherwise(F.lit(""))
    end = F.when(after != "", F.concat(F.lit("\n\n" + T.CONTEXT_AFTER + " "), after)).otherwise(F.lit(""))
    return F.concat(out, text, end)


def is_indexable(text: Column, title: Column, min_bytes: int = 80) -> Column:
    """Long enough, and more than its own title."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.octet_length(t) >= min_bytes) & ((F.trim(title) == "") | (F.lower(t) != F.lower(F.trim(title))))


def merge_small(chunks: DataFrame, by: str, order: str, min_bytes: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, position, chunk_id, title, text and the columns to carry): while a chunk is under min_bytes it takes in the next, keeping its own id and what it carries. One row group a document."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("chunk_id").alias("id"), "title", "text", *carry)))
    rows = chunks.groupBy(by).agg(arr.alias("a"))
    return rows.select(by, F.posexplode(merged("a", min_bytes, carry)).alias("position", "c")).select(by, "position", F.col("c.id").alias("chunk_id"), "c.title", "c.text", *(f"c.{c}" for c in carry))


def merged(a: str, min_bytes: int = 80, carry: tuple[str, ...] = ()) -> Column:
    """merge_small() of a column of arrays of structs (id, title, text and the columns to carry), in order."""
    more = "".join(f", '{c}', {{0}}.{c}" for c in carry)
    one = lambda x: f"named_struct('id', {x}.id, 'title', {x}.title, 'text', {x}.text{more.format(x)})"
    head = one(f"get({a}, 0)")
    fold = f"""aggregate(slice({a}, 2, greatest(size({a}) - 1, 0)),
      named_struct('out', slice(array({head}), 1, 0), 'cur', {head}),
      (s, x) -> if(octet_length(trim(s.cur.text)) < {min_bytes},
        named_struct('out', s.out, 'cur', named_struct('id', s.cur.id, 'title', if(s.cur.title = '' AND x.title <> '', x.title, s.cur.title), 'text', concat(trim(s.cur.text), '\n\n', trim(x.text)){more.format('s.cur')})),
        named_struct('out', concat(s.out, array(s.cur)), 'cur', {one('x')})),
      s -> concat(s.out, array(s.cur)))"""
    return F.when(F.size(a) > 0, F.expr(fold)).otherwise(F.expr(f"slice(array({head}), 1, 0)"))


_SECTIONS = ArrayType(StructType([StructField("title", StringType()), StructField("path", StringType()), StructField("text", StringType()), StructField("legal", BooleanType())]))
_KIND = pa.list_(pa.struct([("title", pa.string()), ("path", pa.string()), ("text", pa.string()), ("legal", pa.bool_())]))


@F.arrow_udf(_SECTIONS)
def sections(text: pa.Array) -> pa.Array:
    """Sections of Markdown by headings (no path yet), or by articles where the text has one heading at most and several of those. A text starts with its title."""
    out = []
    for t in text.to_pylist():
        rows = [{"title": title, "path": None, "text": "\n\n".join(x for x in (title, body) if x), "legal": False} for _, title, body in markup.heading_sections(t)]
        rows = [r | {"title": r["title"] or r["text"].split("\n")[0].strip()} for r in rows]
        if len(rows) <= 1:
            legal = markup.legal_sections(t)
            if len(legal) > 1:
                rows = [{"title": title, "path": path, "text": body, "legal": True} for title, path, body in legal]
        out.append([r for r in rows if r["text"]])
    return pa.array(out, _KIND)


@F.arrow_udf(ArrayType(StructType([StructField("level", IntegerType()), StructField("text", StringType())])))
def _heading_list(text: pa.Array) -> pa.Array:
    return pa.array([[{"level": n, "text": x} for n, x in markup.heading_list(t)] for t in text.to_pylist()], pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])))


def headings(text: Column) -> Column:
    """Array of 'Titre 1: text' and the like, one for each heading of a Markdown text."""
    return F.transform(_heading_list(text), lambda x: F.concat(X.heading_prefix(x["level"]), F.lit(" "), x["level"].cast("string"), F.lit(": "), x["text"]))


@F.arrow_udf(StringType())
def to_markdown(html: pa.Array) -> pa.Array:
    return pa.array([markup.html_to_markdown(t) for t in html.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def to_text(markdown: pa.Array) -> pa.Array:
    return pa.array([markup.markdown_text(t) for t in markdown.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StructType([StructField("title", StringType()), StructField("text", StringType())])))
def _html_blocks(html: pa.Array) -> pa.Array:
    return pa.array([[{"title": a, "text": b} for a, b in markup.html_blocks(t)] for t in html.to_pylist()], pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())])))


def html_chunks(docs: DataFrame, id_col: str = "id", html: str = "content") -> DataFrame:
    """(chunk_id, doc_id, title, section_path, source, position, text): a chunk for each heading, paragraph, list item and piece of code right below a page's body, from 1. None of these is inside a heading, so paths are 'root'."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(_html_blocks(F.col(html))).alias("at", "b"))
    return rows.select(F.concat_ws("-", "doc_id", F.lit("chunk"), F.col("at") + 1).alias("chunk_id"), "doc_id", "b.title", F.lit("root").alias("section_path"), F.lit("html").alias("source"), (F.col("at") + 1).alias("position"), "b.text")


def normalize_documents(docs: DataFrame) -> DataFrame:
    """content as Markdown; what was HTML is kept in original_content."""
    kind = F.lower(F.trim(F.coalesce("content_type", F.lit(""))))
    is_html = kind.startswith("html") | (kind == "text/html")
    content = F.coalesce("content", F.lit(""))
    return docs.withColumn("original_content", F.when(is_html, content).otherwise(F.coalesce("original_content", F.lit("")))).withColumn("content", F.when(is_html, to_markdown(content)).otherwise(content)).withColumn("content_type", F.when(is_html, "html").otherwise("markdown"))


def _parts(sections: Column, cfg: ChunkConfig) -> Column:
    """Sections -> array of (title, path, text): articles in context, long ones as token windows."""
    step = cfg.max_words - cfg.overlap

    def section(s: Column, i: Column) -> Column:
        context = in_context(s["text"], F.get(sections, i - 1)["text"], F.get(sections, i + 1)["text"])
        return F.struct(s["title"].alias("title"), F.coalesce(s["path"], X.section_path(s["title"], i)).alias("path"), F.when(s["legal"], context).otherwise(s["text"]).alias("text"))

    def windows(s: Column, w: Column) -> Column:
        part = lambda text: F.struct(s["title"].alias("title"), s["path"].alias("path"), text.alias("text"))
        last = F.ceil((F.size(w) - cfg.max_words) / F.lit(float(step))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: part(F.array_join(F.slice(w, k * step + 1, F.lit(cfg.max_words)), " ")))
        return F.when(F.size(w) > 2 * cfg.max_words, cut).otherwise(F.array(part(s["text"])))

    return F.flatten(F.transform(F.transform(sections, section), lambda s: X.let(X.fields(s["text"]), lambda w: windows(s, w))))


def chunk_documents(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Documents (normalised) -> chunks, each row on its own: nothing is shuffled.

    Sections by heading, or by article; articles have the sentences next to them put
    around them and a path 'Titre -> article'. Sections of over 2 * max_words words go
    by token windows; small ones merge, keeping the first one's id, path and article;
    what isn't indexable is left out, and a document left with nothing is one chunk if
    it is indexable as a whole. chunk_id is '{doc_id}-chunk-{i}', i by place of origin.
    Null and empty documents have no chunk; rows of one id are chunked each, under that
    id (the store takes one of them first).
    """
    base = docs.select(F.col("id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("doc_title"), F.coalesce("corpus", F.lit("")).alias("corpus"), "content", "content_type")
    # each step in a projection of its own, so that none is made twice
    rows = base.select("*", sections(F.col("content")).alias("s"))
    rows = rows.select("*", _parts(F.col("s"), cfg).alias("p"))
    numbered = F.transform("p", lambda x, i: F.struct(F.concat_ws("-", "doc_id", F.lit("chunk"), i).alias("id"), x["title"].alias("title"), x["text"].alias("text"), x["path"].alias("path")))
    rows = rows.select(*base.columns, numbered.alias("p"))
    rows = rows.select(*base.columns, F.transform(merged("p", cfg.min_bytes, ("path",)), lambda x, i: F.struct(i.alias("position"), x["id"].alias("chunk_id"), x["title"].alias("title"), x["text"].alias("text"), x["path"].alias("path"), F.lit("markdown").alias("source"))).alias("c"))
    rows = rows.select(*base.columns, F.filter("c", lambda x: is_indexable(x["text"], x["title"], cfg.min_bytes)).alias("c"))
    whole = F.struct(F.lit(0).alias("position"), F.concat_ws("-", "doc_id", F.lit("chunk-0")).alias("chunk_id"), F.lit("document").alias("title"), X.strip_markup(F.col("content")).alias("text"), F.lit("document").alias("path"), F.col("content_type").alias("source"))
    rest = F.filter(F.array(whole), lambda x: is_indexable(x["text"], F.lit(""), cfg.min_bytes))
    out = rows.select("doc_id", "doc_title", "corpus", F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(rest)).alias("c")).select("doc_id", "doc_title", "corpus", "c.*")
    return out.select(
        "chunk_id", "doc_id", "corpus", F.when(F.trim("title") == "", F.col("doc_title")).otherwise(F.col("title")).alias("title"), "doc_title",
        F.col("path").alias("section_path"), "source", "position",
        F.when(F.upper("title").startswith("ARTICLE"), X.article_number(F.col("title"))).otherwise("").alias("article"), X.strip_markup(F.col("text")).alias("text"),
    )
