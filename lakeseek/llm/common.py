"""What the operators share: words, names that are free, and the session's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import app_dir, checkpointed, cut, new_path, remove_written, shared_dir

__all__ = ["app_dir", "checkpointed", "cut", "dealt", "fresh", "n_words", "new_path", "remove_written", "shared_dir", "words"]

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ leaves out.
WHITE = r"[\x20\x09-\x0D]+"


#: Rows of one key that a join leaves in one task, at least; and the most keys that can be called hot, which bounds what is broadcast about them.
PER_TASK, HOT_KEYS = 1_000, 100_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores put before as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def n_words(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def dealt(rows: DataFrame, one: DataFrame, counts: DataFrame, on: list[str], salt: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of rows to one on the keys on, and the keys to join on, so that no task gets all rows of a hot key.

    counts (*on, n) says how many of rows each key has. Rows of a key with more than
    PER_TASK are dealt out by a hash of their salt columns to shares of about that
    size, and what one has for the key is repeated for each share. The limit rises
    with the rows, so at most HOT_KEYS keys are hot and broadcast. Keys are not null.
    """
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    per = max(PER_TASK, -(-total // HOT_KEYS))
    if most <= per:
        return rows, one, on
    hot = F.broadcast(counts.where(F.col("n") > per).select(*on, F.ceil(F.col("n") / per).cast("long").alias("_shares")))
    share = F.coalesce(F.pmod(F.xxhash64(*salt), "_shares"), F.lit(0).cast("long"))
    rows = rows.join(hot, on, "left").withColumn("_share", share).drop("_shares")
    one = one.join(hot, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return rows, one, [*on, "_share"]
