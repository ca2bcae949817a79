"""Vectors of texts by a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that the embedder gets at once.
BATCH = 64

Embedder = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with embedding and embed_failed.

    embedder takes a list of texts and gives a vector for each, in their order. Where it
    raises, gives another number of vectors, or an empty one, the texts of that call have
    no vector and embed_failed is true: rows are never lost. Null and empty texts aren't
    sent and have no vector.
    """
    kind = pa.struct([("embedding", pa.list_(pa.float32())), ("failed", pa.bool_())])

    def run(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        out: list[dict] = [{"embedding": None, "failed": False} for _ in every]
        sent = [i for i, t in enumerate(every) if t]
        for s in range(0, len(sent), batch):
            some = sent[s : s + batch]
            try:
                found = [[float(x) for x in v] for v in embedder([every[i] for i in some])]
                if len(found) != len(some) or not all(found):
                    raise ValueError("vectors are missing")
            except Exception:  # the embedder is the user's: whatever it raises costs these texts their vectors
                found = [None] * len(some)
            for i, v in zip(some, found, strict=True):
                out[i] = {"embedding": v, "failed": v is None}
        return pa.array(out, kind)

    of = F.arrow_udf(run, "embedding array<float>, failed boolean").asNondeterministic()
    both = rows.withColumn("__e", of(F.col(text)))
    return both.select(*rows.columns, F.col("__e.embedding").alias("embedding"), F.col("__e.failed").alias("embed_failed"))
