"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet the token constraints, those nearest to taking
every token once (least relative entropy, tokens as base measure) are exponentially
tilted: rate = exp(sum of the duals of the constraints that the document is under).
The convex dual is minimised by Newton steps; what a step needs of the documents is
a sum for each cell of constraint values, aggregated by Spark before anything is
moved. Rates then become whole copies by systematic rounding along sizes, so what a
source takes misses its target by about one long document, not by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target, and no document's copies, go beyond so many times its size.
MOST = 3
#: Documents of one size and source that one task ranks; more are dealt out by hash first.
RANKED = 100_000
#: Offsets tried for the rounding of each source.
PHASES = 64


def _ranked(sources: DataFrame, name: str = "rank") -> DataFrame:
    """sources with their place by code point, null last, from 0: counted inside ranges, so no task sorts all of them."""
    spark, by = sources.sparkSession, F.col("source").asc_nulls_last()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sources.repartitionByRange(parts, by).withColumn("range", F.spark_partition_id()), "sources")
    n = dict(dealt.groupBy("range").count().collect())  # a row a range
    before = spark.createDataFrame([(p, sum(n[q] for q in n if q < p)) for p in n], "range int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return dealt.join(F.broadcast(before), "range").withColumn(name, place).drop("range", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target): a row for each source.

    Sources by code point, null last, weigh weights[0], weights[1], ... and again; they
    share the whole size, a target stops at most * source_size and the excess is
    reshared by weight until none is above. A round of resharing is a sum over sources;
    it ends once a round finds no more that are above, which are fewer each time.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = cut(_ranked(per).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")), "shares")
    level, above = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        total, capped, rest, n = per.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.count_if(over)).first()
        if n == above or not rest:
            break
        level, above = (total - capped) / rest, n
    return per.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, rounds: int = 50, tol: float = 1e-12) -> DataFrame:
    """(source, size) and (source, target) -> (source, rate): Newton on the dual sum_s e^l S_s - l T_s.

    Constraints are one for each source and hold apart, so the Hessian is diagonal and
    a step is a column expression: l += T / (S e^l) - 1, damped to 1 upwards. S is
    summed over all documents once; the steps then touch a row for each source. A
    source of size 0 or target 0 has rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("s"))
    t = targets.select(F.col("source").alias("ts"), F.col("target").alias("t"))
    per = per.join(t, F.col("source").eqNullSafe(F.col("ts"))).withColumn("active", (F.col("s") > 0) & (F.col("t") > 0))
    per = per.withColumn("l", F.lit(0.0)).select("source", "s", "t", "active", "l")
    per = checkpointed(per)
    step = F.when(F.col("active"), F.least(F.lit(1.0), F.try_divide(F.col("t"), F.col("s") * F.exp("l")) - 1)).otherwise(0.0)
    for _ in range(rounds):
        for _ in range(5):
            per = per.withColumn("l", F.col("l") + step)
        per = checkpointed(per)
        off = per.agg(F.max(F.abs(step))).first()[0]
        if off is None or off < tol:
            break
    return per.select("source", F.when(F.col("active"), F.exp("l")).otherwise(0.0).alias("rate"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def copies(rows: DataFrame, rates: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, source, size) with rates -> and copies, whole numbers from 0 to most.

    Of a source's documents in order of size, the i-th has floor(i r + p) - floor((i - 1) r + p)
    copies; p is whichever of PHASES offsets comes nearest the target. Equal sizes are summed first and large groups of them dealt out by hash,
    so places come from counts and no task ranks more than about RANKED rows.
    """
    n = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    n = n.select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.ceil(F.col("n") / RANKED).alias("nb"))
    key = F.xxhash64("doc_id")
    dealt = rows.join(n, _same("source", "s1") & (F.col("size") == F.col("z1"))).select("doc_id", "source", "size", F.pmod(key, F.col("nb")).alias("b"))
    cells = dealt.groupBy("source", "size", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("size", "b")
    cells = cells.withColumn("before", F.sum("n").over(order) - F.col("n"))
    r = rates.select(F.col("source").alias("rs"), "rate")
    cells = cells.join(r, _same("source", "rs")).drop("rs")
    total = lambda p: F.sum(F.col("size") * (F.floor((F.col("before") + F.col("n")) * F.col("rate") + p) - F.floor(F.col("before") * F.col("rate") + p)))
    off = lambda p: F.abs(total(p) - F.sum(F.col("size") * F.col("n") * F.col("rate")))
    best = cells.groupBy("source").agg(F.array_min(F.array(*(F.struct(off(p / PHASES).alias("off"), F.lit(p / PHASES).alias("p")) for p in range(PHASES)))).alias("best"))
    cells = cells.join(best.select(F.col("source").alias("ps"), F.col("best.p").alias("p")), _same("source", "ps"))
    cells = cells.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("b").alias("b2"), "before", "rate", "p")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "b").orderBy(key, "doc_id")))
    ranked = ranked.join(cells, _same("source", "s2") & (F.col("size") == F.col("z2")) & (F.col("b") == F.col("b2")))
    i = F.col("before") + F.col("k")
    taken = F.floor(i * F.col("rate") + F.col("p")) - F.floor((i - 1) * F.col("rate") + F.col("p"))
    return ranked.select("doc_id", "source", "size", F.least(taken, F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row.

    size: words of the whole text (null: 0); taken = copies * size. Null sources are a
    source, the last; the empty name is another. Repeated rows and ids each count.
    Places go by hash and id, so reruns agree. An empty table gives an empty table.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    targets = cut(source_targets(rows, weights, most), "targets")
    taken = copies(rows, balance(rows, targets), most)
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    return taken.join(t, _same("source", "ts")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
