"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one
bit of one of two disjoint halves of 31 bits. In each half the anchors are the
words of the perfect Hamming code [31, 26]: covering radius 1, so every half has
one home anchor within 1. A fingerprint is copied to every anchor within
radius + threshold = 1 + 1 = 2 of its half: 16 at most. If two halves differ in
at most one bit, the home anchor of either is within 2 of the other, so they meet
there; what meets is compared in all 64 bits. No pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, fresh
from .graph import connected_components

HALF = 31
#: Rows of an anchor that are compared in one go; larger anchors are dealt out as pairs of blocks.
BLOCK = 1024
#: Shares that the rows of a component are dealt out in.
SHARES = 32
#: Keys of rows that go, or come more than once, up to which they are broadcast (24 bytes each); beyond, documents are joined to them by shuffle.
BROADCAST_KEYS = 500_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text, as an unsigned number; 0 where there is no word."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    codes = np.fromiter((h(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 16):
        part = codes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


_fingerprints = _fingerprints.asNondeterministic()  # else a filter on its result makes Spark call it twice


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Each row with its fingerprint as a signed long."""
    return docs.withColumn(name, _fingerprints(F.col(text)))


def _syndrome(v: Column) -> Column:
    """Of a 31-bit word: the XOR of the places (1 to 31) of its ones; 0 for code words."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, HALF + 1) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(mask).cast("long"))) % 2, k)
    return out.cast("int")


def anchors(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp, home): a row for each anchor within radius + threshold, in either half."""
    bit = lambda p: F.expr(f"shiftleft(1L, {p} - 1)")
    rows = fps.select("fp", F.explode(F.array(
        *(F.struct(F.lit(k).cast("long").alias("k"), F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit((1 << HALF) - 1).cast("long")).alias("v")) for k in (0, 1))
    )).alias("h")).select("fp", "h.k", "h.v").withColumn("s", _syndrome(F.col("v")))
    home = F.when(F.col("s") == 0, F.col("v")).otherwise(F.col("v").bitwiseXOR(bit("s")))
    near = F.expr(f"IF(s = 0, CAST(array() AS ARRAY<BIGINT>), transform(filter(sequence(1, {HALF}), i -> i <> s AND (i ^ s) > i), i -> v ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)))")
    at = F.concat(F.array(F.struct(home.alias("a"), F.lit(True).alias("home"))), F.transform(near, lambda a: F.struct(a.alias("a"), F.lit(False).alias("home"))))
    rows = rows.select("fp", "k", F.explode(at).alias("x"))
    return rows.select(F.shiftleft("k", HALF).bitwiseOR(F.col("x.a")).alias("key"), "fp", F.col("x.home").alias("home"))


def _forest(fp: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: as many edges as needed to keep what is reachable."""
    n, seen, a, b = len(fp), np.zeros(len(fp), bool), [], []
    for r in range(n):
        if seen[r]:
            continue
        seen[r], front = True, [r]
        while front:
            u = front.pop()
            new = np.flatnonzero(link[u] & ~seen)
            seen[new] = True
            a.append(np.full(len(new), fp[u]))
            b.append(fp[new])
            front.extend(new.tolist())
    return np.concatenate(a), np.concatenate(b)


def _compare(limit: int):
    def links(fp, home, blk):
        close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= limit
        close &= home[:, None] | home[None, :]
        if (blk != blk[0]).any():
            close &= blk[:, None] != blk[None, :]  # each block meets itself elsewhere
        np.fill_diagonal(close, False)
        return _forest(fp, close) if close.any() else None

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []

        def groups(rows: list[np.ndarray], last: bool):
            """Whole groups of what is sorted by key and block pair; the last may go on, so it is held."""
            key, bi, bj, fp, home, blk = rows
            ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
            starts = np.concatenate([[0], ends]).astype(int)
            stops = np.concatenate([ends, [len(key)]]).astype(int)
            done, out = len(starts) - (not last), []
            for s, e in zip(starts[:done], stops[:done], strict=True):
                if e - s > 1 and (found := links(fp[s:e], home[s:e], blk[s:e])) is not None:
                    out.append(found)
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
            held[:] = [] if last else [x[starts[-1] :] for x in rows]

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[3] = new[3].view(np.uint64)
            rows = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(rows[0]):
                yield from groups(rows, False)
        if held:
            yield from groups(held, True)

    return run


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Distinct (fp) -> (a, b): links that connect whatever differs in limit bits or fewer, a spanning forest for each anchor.

    At an anchor the fingerprints whose home it is meet all others. One of many
    fingerprints is dealt out as pairs of blocks of BLOCK rows, homes and others apart,
    so no task gets it whole, none emits all its pairs, and what isn't at home is copied
    once for each block of homes only.
    """
    if limit > 3:
        raise ValueError("the anchors cover three differing bits at most")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = anchors(fps.repartition(parts))  # 8 bytes a row: few partitions would each copy many rows
    busy = at.groupBy("key").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("o")).where("h > 0 AND h + o > 1")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    large = (F.col("h") + F.col("o")) > BLOCK
    # what anchors() makes is taken for as little as what it reads, so Spark would broadcast all of it
    met = at.join(busy.hint("merge"), "key").withColumn("hb", F.when(large, blocks("h")).otherwise(1)).withColumn("ob", F.when(large, blocks("o")).otherwise(0))
    place = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    blk = F.when(F.col("home") | (F.col("ob") == 0), place("hb")).otherwise(F.col("hb") + place("ob"))
    meets = F.when(F.col("home") & (F.col("ob") > 0), F.col("hb") + F.col("ob") - 1).otherwise(F.col("hb") - 1)  # homes meet all, others meet homes
    met = met.withColumn("blk", blk).withColumn("o", F.explode(F.sequence(F.lit(0), meets)))
    met = met.select("key", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "fp", "home", "blk")
    return met.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_compare(limit), "a long, b long")


def _classes(rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, fp) rows -> (fp, root, component_id): a row for each fingerprint."""
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = connected_components(links(own.select("fp"), limit))
    own = own.join(root, own.fp == root.node, "left")
    share = F.when(F.col("node").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.lit(SHARES)).cast("int"))  # what has no link is its own component
    own = own.select("fp", "least", F.coalesce("root", "fp").alias("root"), share.alias("share"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = named.select("root", "component_id", F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SHARES - 1)))).alias("share"))
    return own.join(named, ["root", "share"]).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Fingerprints are over whole texts (null or no word: zero, linked like any
    other). component_id is the smallest doc_id reachable; rows with a null id get
    a component too but never name one (null if all ids of it are null). Repeated
    ids and rows each give a row; where ids repeat with other texts, components that
    are not linked can have one name. An empty table gives an empty table.
    """
    rows = cut(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    to = _classes(rows, limit).select("fp", "component_id")
    return rows.join(to, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 3) -> DataFrame:
    """The rows, with all their columns, less all but one of each component: that of the smallest doc_id stays.

    Of rows that share this id that of the least fingerprint, then text hash, stays,
    once: rows equal in id and text too are one. A component of null ids keeps one row.
    Where ids repeat, components that share a name keep a row each.
    Only keys are shuffled, and documents that come more than once; the others are read
    past the keys of what goes.
    """
    row, none, key, th, order = fresh(docs, "__row", "__none", "__key", "__th", "__order")
    own_key = {none: F.col(doc_id).isNull(), key: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), th: F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    keys = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    rows = cut(with_fingerprint(keys).select("doc_id", "th", "fp"), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th"))
    kept = rows.join(_classes(rows, limit).select("fp", "root"), "fp").groupBy("root").agg(best.alias("x"))
    named = lambda c: [F.col(f"{c}doc_id").isNull().alias(none), F.coalesce(f"{c}doc_id", F.lit(0)).alias(key), F.col(f"{c}th").alias(th)]
    kept = kept.select(*named("x.")).distinct().withColumn("kept", F.lit(True))
    ids = [none, key, th]
    touched = rows.select(*named("")).groupBy(*ids).agg(F.count("*").alias("n")).join(kept, ids, "left").where("kept IS NULL OR n > 1")
    touched = cut(touched.select(*ids, F.col("kept").isNotNull().alias("kept")), "touched")
    n, again = touched.agg(F.count("*"), F.count_if("kept")).first()
    side = (lambda df: F.broadcast(df)) if n <= BROADCAST_KEYS else (lambda df: df)
    left = docs.withColumns(own_key).join(side(touched.select(*ids)), ids, "left_anti").select(*docs.columns)
    if again:  # rows equal in id and text: one of them stays
        twice = docs.select(F.struct(*docs.columns).alias(row), F.xxhash64(*docs.columns).alias(order), *(c.alias(k) for k, c in own_key.items()))
        twice = twice.join(side(touched.where("kept").select(*ids)), ids, "left_semi").groupBy(*ids).agg(F.min_by(row, order).alias(row))
        left = left.unionByName(twice.select(f"{row}.*"))
    return left
