"""Statistics kept by a stream of commits, held against those of the whole log."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import text as X
from lakeseek.jobs.engine import Engine
from lakeseek.operators import stats
from lakeseek.sources.files import DOCUMENT
from lakeseek.streaming.ingest import stats_stream, streamed_stats


def docs(spark, *rows):
    return spark.createDataFrame([(i, i, text, "markdown", "", corpus, "", "") for i, corpus, text in rows], DOCUMENT)


def test_stream_and_log_agree(spark, tmp_path):
    """Replaced and deleted documents, a compaction and a reset, whether a batch has one commit or many; batches that run again change nothing."""
    engine = Engine(spark, str(tmp_path / "store"))
    one, many = str(tmp_path / "one"), str(tmp_path / "many")

    def told(df):
        return {r.corpus: tuple(r)[1:] for r in df.collect()}

    def agree():
        stats_stream(engine, one, 1).awaitTermination()
        assert told(streamed_stats(engine, one)) == told(engine.stats())

    body = "# Head\n\nA long enough sentence to be kept as a chunk of its own, as it has over eighty bytes in it.\n\n"
    engine.ingest(docs(spark, ("a", "x", body), ("b", "y", body * 2), ("c", "", body)))
    agree()
    engine.ingest(docs(spark, ("a", "x", body * 3), ("d", "x", body)))
    engine.delete(["b"])
    agree()
    engine.compact()
    engine.ingest(docs(spark, ("e", "y", body)))
    agree()
    last = max((p for p in Path(one, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):  # as if the driver had died before the batch counted
        if p.exists():
            os.remove(p)
    agree()
    assert told(engine.stats())["x"][0] == 2 and told(engine.stats())["y"][4] == "e"
    engine.reset()
    agree()
    stats_stream(engine, many).awaitTermination()
    assert told(streamed_stats(engine, many)) == told(engine.stats())


def test_sums_add_up(spark):
    """Parts of a log in any division give its totals, and what is taken away leaves none but the last document."""
    log = spark.createDataFrame([(["ingest", "delete"][i % 5 == 4], f"d{i}", ["x", "", None][i % 3], i % 4, i % 2, i % 7 == 0, i) for i in range(100)], "event string, doc_id string, corpus string, chunks int, embedded int, failed boolean, at long")
    log = log.withColumn("at", F.timestamp_seconds("at")).withColumn("failed", F.col("failed").cast("int"))
    parts = [stats.sums(log.where(f"at {cond} timestamp_seconds(33)")) for cond in ("<", ">=")]
    assert sorted(map(str, stats.total(parts[0].unionByName(parts[1])).collect())) == sorted(map(str, stats.totals(log).collect()))
    none = stats.total(stats.sums(log).unionByName(stats.sums(log, -1))).collect()
    assert all(r.documents == r.chunks == r.embedded == r.failures == 0 and r.last_document for r in none)


@pytest.mark.parametrize("section, article, want, ok", [("Titre II", "", " titre ii ", True), ("Titre II", "", "", False), ("Titre II", "5", " \t", False), ("x", "1er", "article 1ER", True), ("x", "", "ARTICLE ", False), ("x", "16", "ARTICLE 16", True), ("Titre", "", "titre i", False)])
def test_sections_by_part_or_article(spark, section, article, want, ok):
    row = spark.createDataFrame([(section, article, want)], "s string, a string, w string")
    assert row.select(X.section_matches(F.col("s"), F.col("a"), F.col("w"))).first()[0] is ok
