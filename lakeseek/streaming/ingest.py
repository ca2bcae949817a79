"""Documents as a stream: each micro-batch replaces what it has by document id."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.engine import COMMITS, Engine
from ..operators import stats
from ..sources.files import DOCUMENT


def ingest_stream(engine: Engine, folder: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """JSON documents that arrive in folder go to the engine. A batch is a commit named by the stream's checkpoint and its number, so one that runs again is written once."""
    name = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            engine.ingest(rows, commit=f"stream-{name}-{epoch}")

    source = engine.spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sums_dir(engine: Engine, checkpoint: str) -> str:
    return f"{engine.root}/sums/{hashlib.sha1(checkpoint.encode()).hexdigest()[:16]}"


def stats_stream(engine: Engine, checkpoint: str, commits_per_batch: int = 1000) -> StreamingQuery:
    """Statistics kept up with the store: a micro-batch of commits adds a row a corpus, so streamed_stats() never reads the log again.

    The store must have a commit. A batch that runs again writes the same folder; commits
    may come in any order, as what they add are sums. The files of commits that a
    compaction or reset replaced must stay until the stream has passed it.
    """
    to = _sums_dir(engine, checkpoint)

    def batch(rows: DataFrame, epoch: int) -> None:
        ids = sorted({r["id"] for r in rows.select("id").collect()})  # commits_per_batch at most
        engine.log_change(ids).coalesce(1).write.mode("overwrite").parquet(f"{to}/{epoch}")

    source = engine.spark.readStream.schema(COMMITS).option("maxFilesPerTrigger", commits_per_batch).json(f"{engine.root}/commits/*")
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_stats(engine: Engine, checkpoint: str) -> DataFrame:
    """Engine.stats() from what stats_stream() has written: a row a corpus and batch."""
    return stats.total(engine.spark.read.parquet(f"{_sums_dir(engine, checkpoint)}/*"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by window and type; works on streams and tables alike. Rows later than the watermark go."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
