"""What each filter takes from the others: five filters over documents in every order.

A document's failures are five bits. A to D are measured in one scan; E, a text that a
smaller doc_id has as well, comes from an existential self-join: documents whose hash
comes again are semi-joined on hash, exact text and smaller doc_id. The ids that fail
E are united with the others' bits, and documents of equal bits are counted: 32 counts
a part hold all that any order can ask, so the 120 orders are worked out from these.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, words

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Hashes that come again are broadcast up to this number (8 bytes each); beyond, documents are joined to them by shuffle.
BROADCAST_HASHES = 1_000_000


def failures(text: Column) -> Column:
    """Bits of A (under 100 words), B (under 80 % of the words are distinct), C (over 10 % of the code points are A-Z) and D (holds any of #$%&*|)."""
    bits = F.transform(
        F.array(words(text)),  # the words are made once, as an element
        lambda w: F.when(F.size(w) < 100, BIT["A"]).otherwise(0) + F.when(F.size(F.array_distinct(w)).cast("long") * 100 < F.size(w).cast("long") * 80, BIT["B"]).otherwise(0),
    )
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rest = F.when(upper.cast("long") * 100 > F.length(text).cast("long") * 10, BIT["C"]).otherwise(0) + F.when(F.length(F.translate(text, "#$%&*|", "")) < F.length(text), BIT["D"]).otherwise(0)
    return (F.get(bits, 0) + rest).cast("int")


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, h, k, part) of the documents whose text a smaller doc_id has: E. docs has these columns and text; rows all but the text.

    Only texts whose hash comes again are moved. The smaller ids' side is one row for
    each text, that of its smallest id, which is there before any join: a larger
    group costs no more than its rows, and those are dealt out in shares.
    """
    seen = cut(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "n"), "audit-hashes")
    few = seen.count() <= BROADCAST_HASHES
    again = docs.where("doc_id is not null").join(F.broadcast(seen.select("h")) if few else seen.select("h"), "h", "left_semi")
    least = again.groupBy("h", "text").agg(F.min("doc_id").alias("lo"))
    left, right, on = dealt(again, least, seen, ["h"], ["doc_id"])
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    same = [left[c] == right[f"{c}_"] for c in [*on, "text"]]
    return left.join(right, [*same, right["lo_"] < left["doc_id"]], "left_semi").select("doc_id", "h", "k", "part")


def combinations(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part that fail just these filters, and how many of them labels call good and toxic.

    Rows are documents: rows of equal id, text and lang count each and fail alike; a
    null doc_id is smaller than none and has no label. An id that labels has more
    than once is good (toxic) if any of its rows says so.
    """
    text, spark = F.coalesce("text", F.lit("")), documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    docs = docs.select("doc_id", "part", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(FILTERS), "text", "part").alias("k"))
    rows = cut(docs.select("doc_id", "h", "k", "part", failures(F.col("text")).alias("bits")), "audit-rows")
    e = repeats(docs, rows).select("doc_id", "h", "k", "part", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    every = rows.withColumn("n", F.lit(1).cast("long")).unionByName(e).groupBy("doc_id", "h", "k", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("long").alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))])
    known = known.where("good + toxic > 0")
    every = every.join(known, "doc_id", "left").select("part", "bits", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    return every.groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang, null as ''), each of the 120 orders and each of its 5 steps, zeros included.

    Texts are whole, null ones empty (they fail A only, and E beside another empty
    text). An empty table has no parts and no rows.
    """
    parts = combinations(documents, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # 32 at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("masks", F.expr("transform(split(filter_order, ''), x -> shiftleft(1, ascii(x) - ascii('A')))"))
    rows = rows.withColumn("own", F.get("masks", F.col("step") - 1)).withColumn("before", F.aggregate(F.slice("masks", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x))
    own, before = F.col("own"), F.col("before")
    fails, earlier = (lambda x: x["bits"].bitwiseAND(own) != 0), (lambda x: x["bits"].bitwiseAND(before) != 0)

    def total(where, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("c", where), F.lit(0).cast("long"), lambda a, x: a + value(x))

    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~earlier(x)).alias("kept"),
        total(lambda x: fails(x) & ~earlier(x)).alias("removed"),
        total(lambda x: fails(x) & earlier(x)).alias("redundant"),
        total(lambda x: x["bits"] == own).alias("unique_fails"),
        total(lambda x: fails(x) & ~earlier(x), lambda x: x["good"]).alias("good_lost"),
        total(lambda x: fails(x) & ~earlier(x), lambda x: x["toxic"]).alias("toxic_lost"),
        # of 120 orders, each of a document's failures comes first in 120 / failures
        total(fails, lambda x: (x["n"] * 120 / F.bit_count(x["bits"])).cast("long")).alias("shapley"),
    )
