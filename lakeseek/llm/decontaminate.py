"""Benchmark decontamination by greedy string tiling.

Token windows (seeds) that a document shares with a test item start matches; the
longest match that overlaps no tile yet becomes a tile, again and again (found by
running Karp-Rabin: window hashes, then comparison). A document is contaminated by
an item whose tokens its tiles cover by a threshold, in whatever order they come.

The test items are a stated query set held against all documents: they are dealt
into blocks of a bounded size, and a block is all that a pass over the documents
broadcasts. A document is tiled where it lies. With several blocks, what is written
and brought together are the hits of the texts that have some, by a hash of the text.
"""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut, fresh

#: Shortest tile, in tokens.
TILE = 4
#: Share of an item's tokens that tiles must cover.
COVER = 0.5
#: Characters of test items in a block: the bound on what is broadcast.
BLOCK_CHARS = 16_000_000
#: Seeds of a document that are held at once, about; they become runs, one a diagonal.
SEEDS = 1 << 20
#: Texts with hits up to which these are broadcast; beyond, documents are joined to them by shuffle.
BROADCAST_HITS = 200_000

#: ASCII punctuation and control characters part tokens; what isn't ASCII belongs to them.
_PART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PART).split()


def _windows(ids: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of k tokens that start at the given places."""
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = (h ^ ids[at + i].astype(np.uint64)) * _P
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Seeds of a block of items: sorted window hashes, each with its item and place. An item shorter than a tile has one seed, itself."""

    def __init__(self, items: list[tuple[int, str]], tile: int = TILE):
        self.tile, self.known = tile, {}
        self.ids, self.items = [], []
        found: dict[int, list[tuple]] = {}
        for item_id, text in items:
            t = tokens(text)
            if not t:
                continue
            ids = np.array([self.known.setdefault(x, len(self.known) + 1) for x in t], np.int64)
            k = min(tile, len(t))
            h = _windows(ids, k, np.arange(len(ids) - k + 1))
            found.setdefault(k, []).append((h, np.full(len(h), len(self.ids)), np.arange(len(h))))
            self.items.append(item_id)
            self.ids.append(ids)
        #: By seed length: hashes, items and places, sorted by hash.
        self.seeds = {}
        for k, some in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[k] = h[order], item[order], place[order]

    def _runs(self, ids: np.ndarray, k: int) -> np.ndarray:
        """(item, place in the document, place in the item, length) of the longest matches of k tokens or more, sorted by item; hashes are compared only here."""
        hashes, items, places = self.seeds[k]
        known, ok = ids > 0, np.ones(max(len(ids) - k + 1, 0), bool)
        for j in range(k):
            ok &= known[j : len(ok) + j]
        at = np.flatnonzero(ok)
        h = _windows(ids, k, at)
        lo, n = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        n -= lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), SEEDS), "left") if len(n) else []
        parts = []
        for s, e in zip(cuts, [*cuts[1:], len(n)], strict=False):
            m = n[s:e]
            if not len(m):
                continue
            seed = np.repeat(lo[s:e] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            parts.append(_join(np.stack([items[seed], np.repeat(at[s:e], m), places[seed], np.full(len(seed), k)]), k))
        return _join(np.concatenate(parts, axis=1), k) if parts else np.zeros((4, 0), np.int64)

    def hits(self, text: str | None, cover: float = COVER) -> list[tuple[int, float]]:
        """(item_id, share covered) of the items that the text covers by cover or more."""
        get, t = self.known.get, tokens(text)
        ids, out = np.fromiter(map(get, t, repeat(0)), np.int32, len(t)), []
        for k in self.seeds:
            item, doc_at, place, length = self._runs(ids, k)
            which, start = np.unique(item, return_index=True)
            for i, s, e in zip(which, start, [*start, len(item)][1:], strict=True):
                own = self.ids[i]
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, place[s:e], 1)
                np.add.at(edge, place[s:e] + length[s:e], -1)
                if (np.cumsum(edge)[:-1] > 0).sum() < cover * len(own):  # tiles can't cover more than the runs do
                    continue
                share = tiled(ids, own, doc_at[s:e], place[s:e], length[s:e], k) / len(own)
                if share >= cover:
                    out.append((self.items[i], share))
        return out


def _join(runs: np.ndarray, k: int) -> np.ndarray:
    """Runs of one diagonal that overlap by k - 1 tokens or more, or follow each other by one, as one."""
    item, doc_at, place, length = runs
    order = np.lexsort((doc_at, doc_at - place, item))
    item, doc_at, place, length = runs[:, order]
    ends = doc_at + length
    new = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(doc_at - place) != 0) | (doc_at[1:] + k - 1 > ends[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(item)]]) - 1
    return np.stack([item[first], doc_at[first], place[first], ends[last] - doc_at[first]])


def tiled(doc: np.ndarray, item: np.ndarray, doc_at: np.ndarray, place: np.ndarray, length: np.ndarray, k: int) -> int:
    """Tokens of the item that greedy string tiling marks, given all runs of k tokens or more (by hash: compared here).

    The longest match of unmarked tokens is marked, of equally long ones the first in
    the document, then in the item; and so on while there is one of k tokens.
    """
    heap = []
    for d, p, n in zip(doc_at.tolist(), place.tolist(), length.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[1], doc[d : d + n] != item[p : p + n], [1]])))
        heap += [(-int(e - s), d + int(s), p + int(s)) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= k]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    while heap:
        n, d, p = heapq.heappop(heap)
        n = -n
        taken = in_doc[d : d + n] | in_item[p : p + n]
        if not taken.any():
            in_doc[d : d + n] = in_item[p : p + n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))  # what is left of the match goes back
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), d + int(s), p + int(s)))
    return int(in_item.sum())


_HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType())]))


def _finder(spark: SparkSession, items: list[tuple[int, str]], tile: int, cover: float):
    shared = spark.sparkContext.broadcast(items)
    built: list[Index] = []

    def find(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Index(shared.value, tile))
        found = [[{"item_id": i, "coverage": c} for i, c in built[0].hits(t, cover)] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())])))

    return F.arrow_udf(find, _HITS).asNondeterministic()


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", tile: int = TILE, cover: float = COVER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs and a column of the hits (item_id, coverage) of each row's whole text; name must be no column of docs.

    Items of one to tile - 1 tokens are hit by texts that hold them whole. Null and
    empty texts meet nothing; items without an id or a token are left out.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def finder(b: int):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_chars
        return _finder(docs.sparkSession, [tuple(r) for r in some], tile, cover)(F.col("text"))

    if blocks == 1:
        return docs.withColumn(name, finder(0))
    x, y, more = fresh(docs, "__x", "__y", "__more")
    keys = {x: F.xxhash64("text"), y: F.xxhash64(F.lit(1), "text")}
    found = None
    for b in range(blocks):
        some = docs.select(F.col("text"), finder(b).alias(more)).where(F.size(more) > 0).select(*(c.alias(k) for k, c in keys.items()), more)
        some = cut(some.groupBy(x, y).agg(F.any_value(more).alias(more)), "hits")  # texts with hits only
        found = some if found is None else found.unionByName(some)
    found = found.groupBy(x, y).agg(F.flatten(F.collect_list(more)).alias(more))  # an item's hit once at most
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    rows = docs.withColumns(keys).join(found, [x, y], "left")
    return rows.select(*docs.columns, F.coalesce(more, F.array().cast(_HITS)).alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, cover: float = COVER) -> DataFrame:
    """(doc_id, contaminated, item_ids, best_item, coverage) for each row.

    item_ids: the items covered by the threshold or more, ascending; best_item the one
    covered most (ties: smallest), coverage its share, both null if there is none.
    Null and empty texts meet nothing; items with fewer tokens than a tile are met whole. Repeated rows each give a row.
    """
    rows = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "hits", tile, cover)
    best = F.element_at(F.array_sort(F.transform("hits", lambda x: F.struct((-x.coverage).alias("c"), x.item_id.alias("i")))), 1)
    rows = rows.select("doc_id", "hits", F.when(F.size("hits") > 0, best).alias("best"))
    return rows.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("hits", lambda x: x.item_id))).alias("item_ids"), F.col("best.i").alias("best_item"), (-F.col("best.c")).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, cover: float = COVER) -> DataFrame:
    """The rows, with all their columns, that no item contaminates."""
    (name,) = fresh(docs, "__hits")
    return with_hits(docs, benchmark, name, tile, cover).where(F.size(name) == 0).drop(name)
