"""The library as one object: an append-only store of documents, chunks and postings below a root folder."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, embedding, evalkit, excerpt, generation, index, lexical, stats
from ..operators import retrieve as ranking
from ..session import cut, ship
from ..sources import files

#: How chunks are made; an index of another version should be built anew.
CHUNKING_VERSION = "3"

_CHUNKS = "chunk_id string, doc_id string, corpus string, title string, doc_title string, section_path string, source string, position int, article string, text string, embedding array<float>, embed_failed boolean, committed long"
#: Tables of a commit. committed: when, in microseconds, so that a later mark of a document takes out its earlier rows only.
TABLES = {
    "documents": "doc_id string, title string, corpus string, content string, content_type string, original_content string, book_title string, article string, committed long",
    "chunks": _CHUNKS,
    "postings": index.SCHEMAS["postings"] + ", committed long",
    "term_df": index.SCHEMAS["term_df"],
    "counts": "n long, tokens long",
    "marks": "doc_id string, marked long",
    "log": "event string, doc_id string, corpus string, chunks long, embedded long, failed long, at timestamp",
}
_SNAPSHOT = "path string, doc_id string, length long, modified timestamp, run long"
# Fixed value: what a query without hits is told.
NOTHING = "Aucun résultat pertinent"
COMMITS = "id string, at long, kind string, replaces array<string>, tables array<string>"


class Engine:
    """A commit is a folder of tables, and counts once its entry in commits is there: readers never see half of one.

    Nothing is rewritten by ingest() and delete(): they add rows, and marks that take out
    what a document had before; document frequencies and lengths are sums of what commits
    add and take away. compact() folds all into one commit. Ids of commits are unique, so
    writers don't overwrite each other's; of two that bring the same new document at once
    both stay until it comes again. A commit of a given id is written once, so a batch
    that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]] | None = None, model: str = ""):
        self.spark, self.root, self.embed = ship(spark), root.rstrip("/"), embed
        self.settings = {"chunking_version": CHUNKING_VERSION, "embeddings_enabled": embed is not None, "embedding_model": model}

    # --- commits

    def _read(self, path: str, schema: str, kind: str = "parquet") -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).format(kind).load(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _commits(self) -> list:
        """Commits that count, in order; those that a compaction took in don't."""
        rows = self._read(f"{self.root}/commits/*", COMMITS, "json")
        rows = [] if rows is None else sorted(rows.collect(), key=lambda r: (r["at"], r["id"]))
        gone = {i for r in rows for i in r["replaces"] or ()}
        return [r for r in rows if r["id"] not in gone]

    def _table(self, name: str, commits: list) -> DataFrame:
        paths = [f"{self.root}/data/{r['id']}/{name}" for r in commits if name in r["tables"]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _put(self, name: str, table: str, df: DataFrame) -> DataFrame:
        """Writes a table of a commit, where it stays, and reads it back. It doesn't count before the commit's entry is there."""
        cast = (f"CAST(`{c.split()[0]}` AS {c.split(' ', 1)[1]}) AS `{c.split()[0]}`" for c in TABLES[table].split(", "))
        path = f"{self.root}/data/{name}/{table}"
        df.selectExpr(*cast).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def _commit(self, kind: str, tables: dict[str, DataFrame], at: int, name: str, replaces: list[str] = (), put: list[str] = ()) -> None:
        """Writes a commit's tables and its entry; put: tables that are there already."""
        for k, df in tables.items():
            self._put(name, k, df)
        entry = self.spark.createDataFrame([(name, at, kind, list(replaces), [*put, *tables])], COMMITS).coalesce(1)
        entry.write.mode("ignore").json(f"{self.root}/commits/{name}")

    @staticmethod
    def _new(at: int) -> str:
        return f"{at}-{uuid.uuid4().hex}"

    def _now(self, commits: list) -> int:
        """Later than every commit there is."""
        return max([time.time_ns() // 1000, *(r["at"] + 1 for r in commits)])

    # --- what the store holds

    def _live(self, name: str, commits: list) -> DataFrame:
        """Rows of a table that no later mark of their document takes out."""
        marks = self._table("marks", commits).groupBy("doc_id").agg(F.max("marked").alias("marked"))
        rows = self._table(name, commits)
        if not any("marks" in r["tables"] for r in commits):
            return rows
        found = lexical.held(marks)
        marks = marks if found is None else F.broadcast(self.spark.createDataFrame(found, marks.schema))
        return rows.join(marks.withColumnRenamed("doc_id", "marked_id"), (F.col("doc_id") == F.col("marked_id")) & (F.col("marked") > F.col("committed")), "left_anti")

    def index(self) -> index.Index | None:
        commits = self._commits()
        if not commits:
            return None
        chunks = self._live("chunks", commits)
        df = self._table("term_df", commits).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        vectors = chunks.where("embedding IS NOT NULL").select("chunk_id", "corpus", "embedding")
        return index.Index(chunks.drop("committed"), self._live("postings", commits).drop("committed"), df, index.mean_length(self._table("counts", commits)), vectors)

    def documents(self) -> DataFrame:
        """Stored documents with their content, as Markdown and as it came."""
        return self._live("documents", self._commits()).drop("committed")

    def stats(self) -> DataFrame:
        return stats.totals(self._table("log", self._commits()))

    def log_change(self, ids: list[str]) -> DataFrame:
        """What commits change in the statistics, as stats.sums(): their logs less those of the commits that they replace, as a compaction's log repeats them."""
        rows = self._read(f"{self.root}/commits/*", COMMITS, "json")
        known = {} if rows is None else {r["id"]: r for r in rows.collect()}
        came = [known[i] for i in ids]
        gone = [known[i] for r in came for i in r["replaces"] or ()]
        return stats.sums(self._table("log", came)).unionByName(stats.sums(self._table("log", gone), -1))

    def manifest(self) -> dict:
        """The settings that the store was made with; those of this engine where there are none."""
        rows = self._read(f"{self.root}/manifest", "value string", "text")
        found = [] if rows is None else rows.collect()
        return json.loads(found[0]["value"]) if found else dict(self.settings)

    def warnings(self) -> list[str]:
        """Where the running settings differ from the manifest."""
        return stats.manifest_warnings(self.manifest(), self.settings)

    # --- changes

    def _minus(self, old: DataFrame) -> dict[str, DataFrame]:
        """Document frequencies and lengths of chunks that go, to be taken away."""
        fields = index.chunk_fields(old)
        posted = cut(index.postings(fields), "gone")
        counts = index.corpus_counts(fields, posted)
        return {"term_df": index.term_df(posted).select("term", (-F.col("df")).alias("df")), "counts": counts.select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))}

    def ingest(self, docs: DataFrame, commit: str | None = None) -> None:
        """Chunks, embeds, indexes and stores documents; those that are there already are replaced. Of rows of one id the one of least hash is taken."""
        commits = self._commits()
        if commit is not None and any(r["id"] == commit for r in commits):
            return
        if not commits:
            self.spark.createDataFrame([(json.dumps(self.settings),)], "value string").coalesce(1).write.mode("ignore").text(f"{self.root}/manifest")
        at = self._now(commits)
        again = docs.groupBy("id").count().where("count > 1")
        if not again.isEmpty():  # only these are moved
            often = docs.join(again.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("d")).select("d.*")
            docs = docs.join(again.select("id"), "id", "left_anti").unionByName(often)
        name, own = commit or self._new(at), F.lit(at).alias("committed")
        docs = chunking.normalize_documents(docs.where("coalesce(id, '') <> ''")).withColumnRenamed("id", "doc_id")
        docs = self._put(name, "documents", docs.select("*", own)).drop("committed").withColumnRenamed("doc_id", "id")
        chunks = chunking.chunk_documents(docs)
        chunks = embedding.embed(chunks, self.embed) if self.embed else chunks.withColumns({"embedding": F.lit(None).cast("array<float>"), "embed_failed": F.lit(False)})
        chunks = self._put(name, "chunks", chunks.select("*", own).sortWithinPartitions("chunk_id")).drop("committed")
        fields = index.chunk_fields(chunks)
        posted = self._put(name, "postings", index.with_blocks(index.postings(fields), fields.count(), commit or str(at)).select("*", own))
        tables = {"term_df": index.term_df(posted), "counts": index.corpus_counts(fields, posted)}
        if commits:
            ids = docs.select(F.col("id").alias("doc_id"))
            known = cut(self._live("documents", commits).select("doc_id").join(ids, "doc_id", "left_semi").distinct(), "known")
            tables["marks"] = known.withColumn("marked", F.lit(at))
            old = self._live("chunks", commits).join(known, "doc_id", "left_semi")
            for k, gone in self._minus(old).items():
                tables[k] = tables[k].unionByName(gone)
            tables["term_df"] = tables["term_df"].groupBy("term").agg(F.sum("df").alias("df"))
            log = stats.ingest_log(old, event="delete").unionByName(stats.ingest_log(chunks))
        else:
            log = stats.ingest_log(chunks)
        self._commit("ingest", tables | {"log": log}, at, name, put=["documents", "chunks", "postings"])

    def delete(self, ids: list[str]) -> int:
        """Removes documents; how many there were."""
        commits = self._commits()
        keys = self.spark.createDataFrame([(i,) for i in set(ids)], "doc_id string")
        known = cut(self._live("documents", commits).join(F.broadcast(keys), "doc_id", "left_semi").select("doc_id").distinct(), "known")
        n = known.count()
        if n:
            at = self._now(commits)
            old = self._live("chunks", commits).join(known, "doc_id", "left_semi")
            self._commit("delete", self._minus(old) | {"marks": known.withColumn("marked", F.lit(at)), "log": stats.ingest_log(old, event="delete")}, at, self._new(at))
        return n

    def sync_directory(self, folder: str, corpus: str = "") -> dict[str, int]:
        """Makes the store hold what a folder holds: ingests new and changed files, deletes documents of those that have gone; counts of both.

        What the folder held last is kept below the store's root, by folder and corpus,
        with length and time; files that stayed are not read, and a run without changes
        commits nothing. A run that fails is made good by the next.
        """
        name = hashlib.sha1(f"{folder.rstrip('/')}\0{corpus}".encode()).hexdigest()[:16]
        base = f"{self.root}/folders/{name}"
        runs = self._read(f"{base}/*", _SNAPSHOT)
        known = self.spark.createDataFrame([], _SNAPSHOT) if runs is None else runs.where(F.col("run") == (runs.agg(F.max("run")).first()[0] or 0))
        known = cut(known, "known")
        now = cut(files.snapshot(self.spark, folder), "snapshot")
        gone = [r["doc_id"] for r in known.join(now, "doc_id", "left_anti").select("doc_id").distinct().collect()]
        docs = cut(files.read_changed(self.spark, folder, corpus, known), "changed")
        n = docs.count()
        if n:
            self.ingest(docs)
        deleted = self.delete(gone) if gone else 0
        if n or gone:
            run = time.time_ns() // 1000
            now.select("path", "doc_id", "length", "modified", F.lit(run).alias("run")).write.parquet(f"{base}/{run}")
        return {"ingested": n, "deleted": deleted}

    def compact(self) -> None:
        """Folds all commits into one: marked rows go, and their marks with them. Readers of the old ones are not disturbed; their files stay until someone removes them."""
        commits = self._commits()
        if len(commits) < 2:
            return
        chunks = self._live("chunks", commits)
        df = self._table("term_df", commits).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        at = self._now(commits)
        posted = index.with_blocks(self._live("postings", commits), chunks.count(), str(at)).sortWithinPartitions("term")
        tables = {"documents": self._live("documents", commits), "chunks": chunks.sortWithinPartitions("chunk_id"), "postings": posted, "term_df": df, "counts": self._table("counts", commits).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), "log": self._table("log", commits)}
        self._commit("compact", tables, at, self._new(at), replaces=[r["id"] for r in commits])

    def reset(self) -> None:
        """Empties the store; the log keeps what was there."""
        commits = self._commits()
        if commits:
            log = self._table("log", commits).unionByName(stats.ingest_log(self._live("chunks", commits), event="delete"))
            at = self._now(commits)
            self._commit("reset", {"log": log}, at, self._new(at), replaces=[r["id"] for r in commits])

    # --- questions

    def _vectors(self, queries: DataFrame) -> DataFrame | None:
        """queries with the vectors of their texts; those that can't be had are left out."""
        return embedding.embed(queries, self.embed).where("embedding IS NOT NULL") if self.embed else None

    def _asked(self, queries: DataFrame) -> index.Index:
        if queries.where("trim(coalesce(text, '')) = ''").limit(1).count():
            raise ValueError("a query has no text")
        at = self.index()
        if at is None:
            raise ValueError("nothing is indexed yet")
        return at

    def _pipeline(self, at: index.Index, queries: DataFrame, params: ranking.RetrieveParams, generate: generation.Generator | None, how: dict) -> tuple[DataFrame, DataFrame]:
        own = F.col("retrieval_q") if "retrieval_q" in queries.columns else F.lit("")
        extra = [c for c in ("hyde", "rewrite") if c in queries.columns]
        asked = queries.select("qid", F.col("text").alias("generation_q"), own.alias("retrieval_q"), F.coalesce("corpus", F.lit("")).alias("corpus"), *extra)
        return ranking.pipeline(at, asked, params, generate, self.embed, **how)

    def retrieve(self, queries: DataFrame, params: ranking.RetrieveParams = ranking.RetrieveParams(), expand: bool = False, generate: generation.Generator | None = None, **how) -> DataFrame:
        """Hits for a table of queries (qid, text, corpus), by words and, with an embedder, by vectors; with expand, queries of legal corpora are searched for in rule-made variants too.

        With generate, queries go through all of ranking.pipeline(): variants, rewrites, and
        passages for those whose best hit is weak. They may then have the columns
        retrieval_q, hyde (on, auto, off) and rewrite; how: batch and seconds of a call.
        """
        at = self._asked(queries)
        if generate is not None:
            return self._pipeline(at, queries, params, generate, how)[0]
        if expand:
            rows = ranking.build_queries(queries.select("qid", F.col("text").alias("generation_q"), F.lit("").alias("retrieval_q"), "corpus"))
            vectors = self._vectors(rows)
            return ranking.retrieve_variants(at, rows, params, None if vectors is None else vectors.select("qid", "variant", "corpus", "embedding"))
        vectors = self._vectors(queries)
        return ranking.retrieve(at, queries, params, None if vectors is None else vectors.select("qid", "corpus", "embedding"))

    def search(self, queries: DataFrame, generate: generation.Generator, params: ranking.RetrieveParams = ranking.RetrieveParams(), **how) -> DataFrame:
        """Answers for a table of queries: (qid, status, message, answer, rewrite_queries), a row for each.

        Retrieval is that of retrieve(generate=...); its hits' excerpts are put to the
        generator. status is ok, no_results where nothing was found (the message says so,
        and the generator isn't asked), or failed where the generator gave no answer.
        rewrite_queries: all that was searched for, joined by ' | '.
        """
        at = self._asked(queries)
        hits, variants = self._pipeline(at, queries, params, generate, how)
        hits = cut(hits, "hits")
        own = F.col("retrieval_q") if "retrieval_q" in queries.columns else F.lit("")
        shown_by = ranking.excerpt_queries(queries.select("qid", own.alias("retrieval_q")), variants)
        shown = cut(excerpt.with_excerpts(hits, at.chunks, shown_by), "excerpts")  # read twice: for the prompts and their checklists
        told = excerpt.prompts(shown, queries, params.top_k)
        answers = cut(generation.generate(told, generate, F.col("prompt"), F.col("system"), **how), "answers")
        said = variants.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "text"))), lambda x: x["text"]), " | ").alias("rewrite_queries"))
        rows = queries.select("qid").join(said, "qid", "left").join(answers.select("qid", "generated", F.lit(True).alias("__asked")), "qid", "left")
        status = F.when(F.col("__asked").isNull(), "no_results").when(F.col("generated").isNull(), "failed").otherwise("ok")
        return rows.select("qid", status.alias("status"), F.when(status == "no_results", NOTHING).otherwise("").alias("message"), F.col("generated").alias("answer"), F.coalesce("rewrite_queries", F.lit("")).alias("rewrite_queries"))

    def prompts(self, queries: DataFrame, params: ranking.RetrieveParams = ranking.RetrieveParams()) -> DataFrame:
        hits = self.retrieve(queries, params)
        return excerpt.prompts(excerpt.with_excerpts(hits, self.index().chunks, queries), queries, params.top_k)

    def evaluate(self, gold: DataFrame, params: ranking.RetrieveParams = ranking.RetrieveParams(), path: str | None = None) -> DataFrame:
        """Recall, reciprocal rank and refusals over gold cases; path: where the report goes, as JSON, with the cases. evalkit.gate() says whether it is good enough."""
        q = gold.select(F.col("id").alias("qid"), F.coalesce("retrieval_q", "generation_q").alias("text"), "corpus")
        cases = cut(evalkit.per_case(self.retrieve(q, params), gold, params.top_k), "cases")
        done = evalkit.report(cases)
        if path:
            evalkit.write_report(done, cases, path)
        return done

    def evaluate_excerpts(self, gold: DataFrame, params: ranking.RetrieveParams = ranking.RetrieveParams()) -> DataFrame:
        """(id, section, passed) for each section whose excerpt must hold terms."""
        q = gold.select(F.col("id").alias("qid"), F.coalesce("retrieval_q", "generation_q").alias("text"), "corpus")
        return evalkit.excerpt_cases(excerpt.with_excerpts(self.retrieve(q, params), self.index().chunks, q), gold)
