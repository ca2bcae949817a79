"""Exact nearest neighbours by cosine: against all rows, or against the cells of a stored table that can hold one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut, new_path
from .lexical import top_k

#: Query vectors in a block: what is broadcast at once.
BLOCK = 4096
#: Rows that are held against a block in one product.
ROWS = 2048
#: Cells at most (a table of n vectors has the root of n), rows a cell that pivots are chosen from, what a query's first cells hold in multiples of k, and what is let go below a bound for rounding.
CELLS, SAMPLE, FIRST, SLACK = 2048, 8, 4, 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> places and matrix of the vectors of that length."""
    size = np.array([len(v) for v in vectors])
    return {int(n): (at := np.flatnonzero(size == n), np.array([vectors[i] for i in at], np.float64)) for n in np.unique(size)}


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("size(embedding) > 0").select("qid", F.coalesce("corpus", F.lit("")).alias("corpus"), F.col("embedding").cast("array<double>").alias("embedding"))


def _blocks(rows: DataFrame):
    """The queries in lists of about BLOCK."""
    first = rows.limit(BLOCK + 1).collect()
    blocks = 1 if len(first) <= BLOCK else -(-rows.count() // BLOCK)
    for b in range(blocks):
        yield first if blocks == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()


def _types(vectors: DataFrame, queries: DataFrame) -> tuple[pa.Schema, str]:
    """What _nearest() returns, for Arrow and for Spark."""
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    qid, chunk = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["chunk_id"]
    return pa.schema([("qid", kinds.get(qid, pa.string())), ("chunk_id", kinds.get(chunk, pa.string())), ("score", pa.float64())]), f"qid {qid}, chunk_id {chunk}, score double"


def _vectors(vectors: DataFrame, *more: str) -> DataFrame:
    return vectors.where("size(embedding) > 0").select("chunk_id", F.coalesce("corpus", F.lit("")).alias("corpus"), "embedding", *more)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(chunk_id, corpus, embedding) x (qid, corpus, embedding) -> (qid, chunk_id, score, rank).

    Queries go in blocks of BLOCK, each broadcast and held against all rows once, by one
    matrix product for ROWS rows; these keep k for each query, so what is shuffled is a
    few rows a task. Null and empty vectors are left out; dimensions are compared over
    the shorter. A zero vector is at 0 from all.
    """
    rows = _asked(queries)
    schema, ddl = _types(vectors, rows)
    found = [_vectors(vectors).mapInArrow(_nearest(block, k, schema), ddl) for block in _blocks(rows)]
    return top_k(reduce(DataFrame.union, found), k)


def _nearest(block: list, k: int, schema: pa.Schema, wanted: dict[int, np.ndarray] | None = None, floor: np.ndarray | None = None):
    """The k best of each query among ROWS rows at a time. wanted: the places of the queries that meet the rows of a cell (the fourth column); without it all meet all. floor: scores of the queries that k rows are known to reach, so lower ones aren't returned."""

    def run(batches):
        asked = _by_length([r["embedding"] for r in block]) if block else {}
        corpora_asked = np.array([r["corpus"] for r in block], dtype=object)
        everyone = np.arange(len(block))
        for whole in batches:
            for start in range(0, whole.num_rows if block else 0, ROWS):
                batch = whole.slice(start, ROWS)
                if wanted is None:
                    yield best(batch, everyone, asked, corpora_asked)
                    continue
                cells = batch.column(3).to_numpy()
                for c in np.unique(cells):
                    if len(wanted.get(int(c), ())):
                        yield best(batch.take(pa.array(np.flatnonzero(cells == c))), wanted[int(c)], asked, corpora_asked)

    def best(batch, places, asked, corpora_asked):
        ids, corpora = np.array(batch.column(0).to_pylist(), dtype=object), np.array(batch.column(1).to_pylist(), dtype=object)
        s = np.empty((len(places), batch.num_rows))
        for n, (at, m) in _by_length(batch.column(2).to_pylist()).items():
            for d, (of, q) in asked.items():
                w, here = min(n, d), np.isin(places, of)
                s[np.ix_(here, at)] = _unit(q[np.searchsorted(of, places[here])][:, :w]) @ _unit(m[:, :w]).T
        order = np.argsort(np.argsort(ids, kind="stable"))
        out = ([], [], [])
        for i, p in enumerate(places):
            ok = np.flatnonzero(corpora == corpora_asked[p]) if corpora_asked[p] else np.arange(len(ids))
            if floor is not None:
                ok = ok[s[i, ok] >= floor[p] - SLACK]
            near = np.round(s[i, ok], 9)
            if len(ok) > k:  # all that may be among the k best, ties at the border included
                ok = ok[near >= np.partition(near, len(near) - k)[len(near) - k]]
            top = ok[np.lexsort((order[ok], -np.round(s[i, ok], 9)))[:k]]
            out[0].extend([block[p]["qid"]] * len(top))
            out[1].extend(ids[top].tolist())
            out[2].extend(s[i, top].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


@dataclass(frozen=True)
class Cells:
    """Stored vectors by the pivot that is nearest: rows (chunk_id, corpus, embedding, angle, cell) in a folder a cell, and balls (cell, n, radius, pivot), at most CELLS of them, radius being the largest angle to the pivot. Cell -1 holds what has no angle there: zero vectors, values that are no numbers, other lengths than most."""

    rows: DataFrame
    balls: DataFrame


def cluster(vectors: DataFrame, path: str | None = None) -> Cells:
    """Writes vectors (chunk_id, corpus, embedding) by cell below path (or in the shared folder). Pivots are as many as the root of the rows, chosen among SAMPLE times as many of least hash; which ones sets the speed of nearest() only.

    Rows go to their cells' files through a rebalancing shuffle, so a cell that has a
    third of all rows is several files and tasks.
    """
    spark, path = vectors.sparkSession, path or new_path(vectors.sparkSession, "cells")
    rows = _vectors(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    width, n = (sizes["d"], sizes["n"]) if sizes else (0, 0)
    usable = rows.where((F.size("embedding") == width) & F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < 1e150)))
    few = min(CELLS, int(np.ceil(np.sqrt(n))))
    picked = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE * few).select(F.col("embedding").cast("array<double>").alias("e")).collect() if few else []
    pivots = _pivots(np.array([r["e"] for r in picked], np.float64).reshape(-1, width or 1), few)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", angle double, cell int"
    rows.mapInArrow(_assign(pivots, width), schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    found = _stored(spark, path, rows.schema).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a cell
    balls = [(r["cell"], r["n"], r["radius"], pivots[r["cell"]].tolist() if r["cell"] >= 0 else None) for r in found]
    spark.createDataFrame(balls, "cell int, n bigint, radius double, pivot array<double>").coalesce(1).write.parquet(f"{path}/balls")
    return load_cells(spark, path, rows.schema)


def load_cells(spark: SparkSession, path: str, vectors: StructType) -> Cells:
    """What cluster() has written of vectors (their schema: chunk_id, corpus, embedding)."""
    return Cells(_stored(spark, path, vectors), spark.read.parquet(f"{path}/balls"))


def _stored(spark: SparkSession, path: str, vectors: StructType) -> DataFrame:
    kept = StructType([vectors[c] for c in ("chunk_id", "corpus", "embedding")])
    return spark.read.schema(kept.add("angle", "double").add("cell", "integer")).parquet(f"{path}/rows")


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Half of them the sample's first, so that dense places have many; then always the row that is farthest from all, so that small groups have one."""
    unit = _unit(sample)
    chosen = list(range(min(len(unit), -(-n // 2))))
    best = (unit @ unit[chosen].T).max(axis=1, initial=-1.0)
    while len(chosen) < n and len(unit) and best.min() < 1 - SLACK:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    return np.unique(sample[chosen], axis=0)


def _assign(pivots: np.ndarray, width: int):
    unit = _unit(pivots)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                vectors = batch.column(2).to_pylist()
                angle, cell = np.zeros(len(vectors)), np.full(len(vectors), -1, np.int32)
                at = np.array([i for i, v in enumerate(vectors) if len(v) == width and None not in v], np.int64)
                if len(at) and len(unit):
                    m = np.array([vectors[i] for i in at], np.float64)
                    ok = np.isfinite(m).all(axis=1) & (np.abs(m) < 1e150).all(axis=1) & (m != 0).any(axis=1)
                    at, cosines = at[ok], _unit(m[ok]) @ unit.T
                    cell[at] = cosines.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cosines.max(axis=1, initial=-1.0), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], names=[*batch.schema.names, "angle", "cell"])

    return run


def _bounds(block: list, balls: list) -> np.ndarray:
    """What no row of a cell scores more than, for each query and cell: by the triangle inequality a row's angle is at least that of the pivot less the radius. 2 where nothing is known."""
    out = np.full((len(block), len(balls)), 2.0)
    with_pivot = np.array([i for i, b in enumerate(balls) if b["pivot"] is not None], np.int64)
    if not len(with_pivot):
        return out
    pivots = _unit(np.array([balls[i]["pivot"] for i in with_pivot], np.float64))
    radius = np.array([balls[i]["radius"] for i in with_pivot])
    for d, (of, q) in _by_length([r["embedding"] for r in block]).items():
        if d == pivots.shape[1]:
            known = np.isfinite(q).all(axis=1) & (np.abs(q) < 1e150).all(axis=1) & (q != 0).any(axis=1)
            angle = np.arccos(np.clip(_unit(q[known]) @ pivots.T, -1, 1))
            out[np.ix_(of[known], with_pivot)] = np.cos(np.maximum(angle - radius, 0))
    return out


def _meet(cells: Cells, balls: list, block: list, wanted: np.ndarray, k: int, schema: pa.Schema, ddl: str, floor: np.ndarray | None = None) -> DataFrame:
    """The best of the cells that queries want: (queries, cells) of booleans."""
    to = {b["cell"]: np.flatnonzero(wanted[:, j]) for j, b in enumerate(balls) if wanted[:, j].any()}
    return _vectors(cells.rows, "cell").where(F.col("cell").isin(list(to))).mapInArrow(_nearest(block, k, schema, to, floor), ddl)


def _pruned(cells: Cells, queries: DataFrame, k: int):
    """For each block of queries: the queries, cells, what was searched first and after, and the hits of both."""
    rows = _asked(queries)
    schema, ddl = _types(cells.rows, rows)
    balls = sorted(cells.balls.collect(), key=lambda b: b["cell"])
    n = np.array([b["n"] for b in balls], np.int64)
    for block in _blocks(rows):
        bound = _bounds(block, balls)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < FIRST * k, axis=1)
        first |= bound > 1.5
        hits = cut(top_k(_meet(cells, balls, block, first, k, schema, ddl), k).drop("rank"), "near")
        least = {r["qid"]: r["least"] for r in hits.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        floor = np.array([least.get(r["qid"], -np.inf) for r in block])
        rest = (bound >= floor[:, None] - SLACK) & ~first if len(block) else first
        yield block, n, first, rest, hits.union(_meet(cells, balls, block, rest, k, schema, ddl, floor)) if rest.any() else hits


def nearest(cells: Cells, queries: DataFrame, k: int = 20) -> DataFrame:
    """search() over stored cells, with the same hits: folders that hold none of the k best aren't read.

    A query meets the cells of the best bounds first, until they have FIRST * k rows; the
    k-th best score found there leaves out each cell whose bound is below. Where a query
    has fewer than k rows of its corpus there, no cell is left out. qids are distinct.
    """
    return top_k(reduce(DataFrame.union, [hits for *_, hits in _pruned(cells, queries, k)]), k)


def pruning(cells: Cells, queries: DataFrame, k: int = 20) -> DataFrame:
    """(qid, cells, kept, rows, met) of nearest(): cells that there are and that the query meets, and their rows."""
    spark, qid, out = cells.rows.sparkSession, dict(queries.dtypes)["qid"], []
    for block, n, first, rest, _ in _pruned(cells, queries, k):
        met = first | rest
        rows = [(r["qid"], len(n), int(m.sum()), int(n.sum()), int(n[m].sum())) for r, m in zip(block, met, strict=True)]
        out.append(spark.createDataFrame(rows, f"qid {qid}, cells int, kept int, rows bigint, met bigint"))
    return reduce(DataFrame.union, out)
