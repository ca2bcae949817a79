"""Texts from a pluggable generator: passages, rewrites and answers for a table of prompts."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (system, user) pairs that the generator gets at once, and the seconds that it has for them.
BATCH, SECONDS = 8, 120.0
#: Below this best score a query is given a passage, where its mode is auto.
CONFIDENCE = 0.65

Generator = Callable[[list[tuple[str, str]]], list[str]]

PASSAGE_PROMPT = "Écris un passage inventé de trois ou quatre phrases, comme un texte de la Constitution qui répondrait à la question, avec un numéro d'article vraisemblable, dans un style juridique et sans commentaire.\n\nQuestion : "
REWRITE_PROMPT = "Donne deux requêtes courtes, en mots-clés, pour trouver dans la Constitution les articles dont parle la question ; nomme les articles probables et ne réponds pas.\nUne ligne chacune : « Requête 1 : ... », « Requête 2 : ... ».\n\nQuestion : "


def _within(seconds: float, f: Callable, arg):
    """f(arg), or TimeoutError; a call that never ends is left behind, its thread ends with the worker."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((f(arg), None))
        except BaseException as e:
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if error is not None:
        raise error
    return value


def generate(rows: DataFrame, generator: Generator, prompt: Column, system: Column | None = None, batch: int = BATCH, seconds: float = SECONDS) -> DataFrame:
    """rows with generated and generated_failed.

    Where the generator raises, gives another number of texts or is too slow, the texts
    of that call are null and flagged: rows are never lost. Null and blank prompts
    aren't sent; a blank text counts as none, without a flag.
    """
    kind = pa.struct([("text", pa.string()), ("failed", pa.bool_())])

    def run(systems: pa.Array, prompts: pa.Array) -> pa.Array:
        every = list(zip(systems.to_pylist(), prompts.to_pylist(), strict=True))
        out: list[dict] = [{"text": None, "failed": False} for _ in every]
        sent = [i for i, (_, p) in enumerate(every) if p and p.strip()]
        for s in range(0, len(sent), batch):
            some = sent[s : s + batch]
            try:
                found = [None if t is None else str(t).strip() for t in _within(seconds, generator, [every[i] for i in some])]
                failed = len(found) != len(some)
            except Exception:  # the generator is the user's: whatever it raises costs these rows their texts
                found, failed = [], True
            for i, t in zip(some, [None] * len(some) if failed else found, strict=True):
                out[i] = {"text": t or None, "failed": failed}
        return pa.array(out, kind)

    of = F.arrow_udf(run, "text string, failed boolean").asNondeterministic()
    both = rows.withColumn("__g", of(F.lit("") if system is None else system, prompt))
    return both.select(*rows.columns, F.col("__g.text").alias("generated"), F.col("__g.failed").alias("generated_failed"))


def mode(raw: str | None) -> str:
    """on, auto or off, of a parameter's text."""
    low = (raw or "").strip().lower()
    return "on" if low in ("1", "true", "yes", "on") else "auto" if low == "auto" else "off"


def wants_passage(mode: Column, top: Column) -> Column:
    """Whether a query is given a passage: always, or where its best hit is there and weak."""
    return (mode == "on") | ((mode == "auto") & (top > 0) & (top < CONFIDENCE))


def wants_rewrites(raw: Column, corpus: Column) -> Column:
    """Whether a query may be rewritten: as its parameter says, else in legal corpora."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    own = F.contains(F.lower(F.coalesce(corpus, F.lit(""))), F.lit("legal"))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(own)
