"""Trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from a head of its base and the rest of its own turns. No
rebuilt text is made: a turn is an element (B, x) of a monoid, with the product
(m, v)(n, w) = (m n, v + m w) modulo a prime, so a prefix is B^n and a sum of x B^i. The
sums of every prefix of the original turns are made once; that of a rebuilt prefix is
the base's head times (own prefix less own head), moved by a power of B where the base
is short. Prefixes of equal depth and fingerprint are one node.

That equal fingerprints mean equal turns is verified: the members of a node must have
one parent and one last turn, and turns that are called equal are compared as texts. If
either fails, all is made again with other hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dealt

#: Primes below 2^31 (products fit a long), and bases for each attempt.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = ((1103515245, 1664525, 22695477), (134775813, 214013, 69069), (1812433253, 1566083941, 1284865837), (48271, 16807, 39373))
#: Turns of a base that can go before others, at most.
HEAD = 5
#: Ids that are packed in one block before a node's ends are hashed in order; keys that are broadcast at most.
BLOCK, BROADCAST_KEYS = 256, 1_000_000
_STEP = 256
_FP = ("f1", "f2", "f3")


def power(i: Column, base: int, prime: int) -> Column:
    """base^i modulo prime for i from 0 to 2^32, from the powers of each of its bytes."""
    out = F.lit(1).cast("long")
    for k in range(4):
        table = F.lit(np.array([pow(base, b * _STEP**k, prime) for b in range(_STEP)], np.int64))
        out = out * F.get(table, F.shiftright(i, 8 * k).bitwiseAND(255).cast("int")) % prime
    return out


def head_length(conv_id: Column) -> Column:
    """Turns of the base that come first."""
    return (F.crc32(conv_id.cast("string")) % (HEAD + 1)).cast("int")


def numbered(rows: DataFrame, attempt: int) -> DataFrame:
    """(conv_id, pos, x, y, chars, f1, f2, f3): original turns from 1, two hashes of role and text, and the fingerprint of the prefix that ends there.

    Turns go by turn, nulls first; turns of one number by role, then text. Texts are
    not sorted or moved for that, but those of turns that share a number and differ.
    """
    x, y = F.xxhash64(F.lit(attempt), "role", "text"), F.xxhash64("text", F.lit(-1 - attempt), "role")
    bare = rows.select("conv_id", "turn", x.alias("x"), y.alias("y"), F.length("text").cast("long").alias("chars"))
    tied = bare.groupBy("conv_id", "turn").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).where("a <> b or c <> d").select("conv_id", "turn")
    tied = cut(tied, "trie-tied")
    bare = bare.withColumn("rank", F.lit(0))
    if not tied.isEmpty():
        on = lambda a, b: (a["conv_id"] == b["conv_id"]) & a["turn"].eqNullSafe(b["turn"])
        some = rows.join(tied, on(rows, tied), "left_semi")
        order = some.select("conv_id", "turn", x.alias("x"), y.alias("y"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("r")).groupBy("conv_id", "turn", "x", "y").agg(F.min("r").alias("r"))
        order = order.select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "turn", "x", "y")], "r")
        same = (F.col("conv_id") == F.col("conv_id_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("x") == F.col("x_")) & (F.col("y") == F.col("y_"))
        bare = bare.drop("rank").join(order, same, "left").select("conv_id", "turn", "x", "y", "chars", F.coalesce("r", F.lit(0)).alias("rank"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "rank", "x", "y")
    bare = bare.withColumn("pos", F.row_number().over(w))
    value = {"f1": F.col("x"), "f2": F.col("y"), "f3": F.col("x").bitwiseXOR(F.col("y"))}
    terms = [(F.pmod(value[f], F.lit(p)) * power(F.col("pos"), b, p) % p).alias(f) for f, b, p in zip(_FP, BASES[attempt], PRIMES, strict=True)]
    sums = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = bare.select("conv_id", "turn", "rank", "pos", "x", "y", "chars", *terms)
    return bare.select("conv_id", "pos", "x", "y", "chars", *[(F.sum(f).over(sums) % p).alias(f) for f, p in zip(_FP, PRIMES, strict=True)])


def turns_differ(rows: DataFrame, turns: DataFrame, attempt: int) -> bool:
    """Whether turns of equal hashes differ in role or text. Turns that stand alone are not compared."""
    again = cut(turns.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "trie-again")
    named = rows.select(F.xxhash64(F.lit(attempt), "role", "text").alias("x"), F.xxhash64("text", F.lit(-1 - attempt), "role").alias("y"), "role", "text")
    if again.count() <= BROADCAST_KEYS:
        named = named.join(F.broadcast(again), ["x", "y"], "left_semi")
    return not named.distinct().groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def prefixes(turns: DataFrame, attempt: int) -> DataFrame:
    """(conv_id, depth, total, f1.., p1.., x, y, chars): every prefix of every rebuilt conversation, the root (depth 0) too.

    p is the fingerprint of the prefix one turn shorter; total the rebuilt turns. x, y
    and chars are those of the last turn, which stays a reference to an original one.
    """
    sums = F.struct("pos", "x", "y", "chars", *_FP)
    heads = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= HEAD, sums))).alias("head"))  # HEAD at most
    h = head_length(F.col("conv_id"))
    own = heads.select("conv_id", "n", "head", h.alias("h"), F.expr("conv_id - conv_id % 100").alias("base"))
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))  # up to 100 conversations ask for one (199 around 0)
    convs = own.join(base, "base", "left").withColumn("first", F.coalesce(F.slice("base_head", F.lit(1), F.col("h")), F.slice("head", F.lit(1), F.lit(0))))
    k = F.size("first")
    at = lambda turns, i, f: F.coalesce(F.get(turns, i - 1)[f], F.lit(0).cast("long"))
    convs = convs.select("conv_id", "h", "first", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), *[at(F.col("first"), k, f).alias(f"b{f}") for f in _FP], *[at(F.col("head"), F.col("h"), f).alias(f"o{f}") for f in _FP])
    convs = cut(convs, "trie-heads")
    zero = [F.lit(0).cast("long").alias(f) for f in _FP]
    root = F.struct(F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "chars")], *zero)
    first = F.transform("first", lambda t: F.struct(t["pos"].cast("long").alias("pos"), *[t[c].alias(c) for c in ("x", "y", "chars", *_FP)]))
    opening = convs.select("conv_id", "total", F.explode(F.concat(F.array(root), first)).alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "total", "t.x", "t.y", "t.chars", *[f"t.{f}" for f in _FP])
    rest = turns.join(convs.drop("first"), "conv_id").where("pos > h")
    moved = []
    for f, b, p in zip(_FP, BASES[attempt], PRIMES, strict=True):
        shift = F.get(F.lit(np.array([pow(b, -s, p) for s in range(HEAD + 1)], np.int64)), F.col("h") - F.col("k"))  # the base is short by h - k
        moved.append(((F.col(f"b{f}") + shift * F.pmod(F.col(f) - F.col(f"o{f}"), F.lit(p))) % p).alias(f))
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("depth"), "total", "x", "y", "chars", *moved)
    every = opening.unionByName(rest)
    w = Window.partitionBy("conv_id").orderBy("depth")
    return every.select("*", *[F.lag(f).over(w).alias(f"p{f}") for f in _FP])


def _hash_ends(batches):
    """Blocks of a node's ids, sorted by node and place -> SHA-256 of the joined ids; holds one state."""
    node, state, n = None, None, 0
    done: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", *_FP, "ends_sha256"])

    for b in batches:
        for *key, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state, n = key, hashlib.sha256(), 0
            state.update((("," if n else "") + ids).encode())
            n += 1
        if len(done) >= 10_000:
            yield flush()
            done = []
    if node is not None:
        done.append((*node, state.hexdigest()))
        yield flush()


def ends(every: DataFrame) -> DataFrame:
    """(depth, f1.., ends_sha256) of the nodes that conversations end at: SHA-256 of their ids, ascending, joined by commas.

    Ids are packed in blocks of at most BLOCK; a node's blocks go through one task in
    order, as the hash asks for, and one at a time.
    """
    block = F.expr(f"(conv_id - pmod(conv_id, {BLOCK})) div {BLOCK}")
    packed = every.where("depth = total").groupBy("depth", *_FP, block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed.repartition(parts, "depth", *_FP).sortWithinPartitions("depth", *_FP, "block").select("depth", *_FP, "ids")
    return packed.mapInArrow(_hash_ends, "depth long, f1 long, f2 long, f3 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty. Turns of one number go by role, then text, repeated
    ones each count. Rows of a null conv_id are in no conversation. An empty table has
    no nodes, not even a root. conv_id % 100 keeps the sign, so ids around 0 share base 0.

    A conversation's turns are numbered and summed in one task, in order and without
    being held, whatever their number. A node belongs to its smallest member, which then owns the rest of its path too. So
    each path sums up, from its end, what its owned nodes give, and a node is the sum
    over its members: no level after level, and depth costs nothing.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    for attempt in range(len(BASES)):
        turns = cut(numbered(rows, attempt), "trie-turns")
        if turns_differ(rows, turns, attempt):
            continue
        every = cut(prefixes(turns, attempt), "trie-prefixes")
        same = ["x", "y", *(f"p{f}" for f in _FP)]
        nodes = every.groupBy("depth", *_FP).agg(
            F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("total").alias("deepest"), F.max("chars").alias("chars"),
            *[F.min(c).alias(f"lo_{c}") for c in same], *[F.max(c).alias(f"hi_{c}") for c in same],
        )
        nodes = cut(nodes, "trie-nodes")
        if nodes.where(" or ".join(f"lo_{c} <> hi_{c}" for c in same)).isEmpty():
            break
    else:
        raise RuntimeError("fingerprints met in every attempt")
    given = nodes.select(F.col("owner").alias("conv_id"), "depth", F.col("n_convs").alias("members"), (F.col("deepest") == F.col("depth")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    path = every.select("conv_id", "depth", *_FP, *(f"p{f}" for f in _FP)).join(given, ["conv_id", "depth"], "left")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.col("members").isNotNull()
    path = path.select("conv_id", "depth", *_FP, *(f"p{f}" for f in _FP), F.coalesce(F.sum("leaf").over(below), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved").over(below), F.lit(0)).alias("saved"), F.coalesce(F.lag(mine.cast("long")).over(up), F.lit(0)).alias("children"), mine.alias("mine"), (mine & ~F.coalesce(F.lead(mine).over(up), F.lit(False))).alias("top"), "members")
    path = cut(path, "trie-paths")
    whole = path.groupBy("depth", *_FP).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    whole = cut(whole, "trie-sums")
    # below a member's first own node all parents are its own; the first one's is another's, which many can ask for
    tops = path.where("top and depth > 0").select(F.col("conv_id"), F.col("depth"), (F.col("depth") - 1).alias("up"), *(f"p{f}" for f in _FP))
    parents = whole.where("n_children > 0").select(F.col("depth").alias("up"), *[F.col(f).alias(f"p{f}") for f in _FP], F.col("conv_id").alias("parent_conv_id"))
    on = ["up", *(f"p{f}" for f in _FP)]
    counts = cut(tops.groupBy(*on).agg(F.count("*").alias("n")), "trie-tops")
    left, right, on = dealt(tops, parents, counts, on, ["conv_id"])
    tops = left.join(right, on).select("conv_id", "depth", "parent_conv_id")
    out = whole.join(tops, ["conv_id", "depth"], "left").join(ends(every), ["depth", *_FP], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
