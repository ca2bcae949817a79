"""A folder kept in step with the store, statistics, and retrieval over a gold set that lies elsewhere."""

import os

import pytest

from lakeseek.jobs import cli
from lakeseek.jobs.engine import Engine
from lakeseek.operators import evalkit, stats
from lakeseek.sources import files

BODY = "words of this file that are long enough to make a chunk of their own, at eighty bytes or more. "


def test_sync_reads_what_changed_only(spark, tmp_path):
    folder, store = tmp_path / "docs", Engine(spark, str(tmp_path / "store"))
    (folder / "sub").mkdir(parents=True)
    for name in ("a.md", "sub/b.html", "c.MD"):
        (folder / name).write_text(f"# {name}\n\n" + BODY)
    (folder / "x.pdf").write_bytes(b"\0" * 100)
    assert store.sync_directory(str(folder), "c") == {"ingested": 3, "deleted": 0}
    commits = len(store._commits())
    assert store.sync_directory(str(folder) + "/", "c") == {"ingested": 0, "deleted": 0} and len(store._commits()) == commits
    (folder / "a.md").write_text("# a\n\nanother text now. " + BODY)
    (folder / "c.MD").unlink()
    (folder / "d.markdown").write_text("# d\n\n" + BODY)
    assert store.sync_directory(str(folder), "c") == {"ingested": 2, "deleted": 1}
    got = {r.title: r.content for r in store.documents().collect()}
    assert set(got) == {"a", "b", "d"} and "another text" in got["a"]


def test_foreign_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "big.bin").write_bytes(b"\xff" * 1000)
    plan = files.read_directory(spark, str(tmp_path))
    assert [r.title for r in plan.collect()] == ["a"] and files.snapshot(spark, str(tmp_path)).count() == 1


def test_many_changed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHANGED", 1)
    for i in range(4):
        (tmp_path / f"{i}.md").write_text(str(i))
    known = files.snapshot(spark, str(tmp_path)).where("path LIKE '%0.md'")
    assert sorted(r.content for r in files.read_changed(spark, str(tmp_path), "", known).collect()) == ["1", "2", "3"]


def test_last_document_and_time(spark):
    log = spark.createDataFrame([("ingest", "a", "x", 2, 1, 1, 10), ("ingest", "c", "x", 1, 1, 0, 30), ("ingest", "b", "x", 1, 0, 0, 30), ("delete", "c", "x", 1, 1, 0, 40), ("ingest", "z", "", 1, 0, 2, 5)], "event string, doc_id string, corpus string, chunks int, embedded int, failed int, at long")
    got = {r.corpus: tuple(r)[1:6] + (r.last_at.timestamp(),) for r in stats.totals(log.withColumn("at", log["at"].cast("timestamp"))).collect()}
    assert got == {None: (3, 4, 2, 3, "c", 30.0), "x": (2, 3, 2, 1, "c", 30.0), "_default": (1, 1, 0, 2, "z", 5.0)}


def test_gate(spark):
    report = spark.createDataFrame([(0.6,)], "recall_at_k double")
    assert evalkit.gate(report, 0.65) == (False, 0.6) and evalkit.gate(report, 0.6)[0] and evalkit.gate(report, 0)[0]
    assert evalkit.gate(spark.createDataFrame([(None,)], "recall_at_k double"), 0.1) == (False, 0.0)


@pytest.mark.skipif("GOLD_FILE" not in os.environ, reason="GOLD_FILE and GOLD_DOCS name a gold set and the folder of its documents")
def test_gold_set_reaches_its_gate(spark, tmp_path):
    store = Engine(spark, str(tmp_path))
    gold = files.read_gold(spark, os.environ["GOLD_FILE"])
    store.sync_directory(os.environ["GOLD_DOCS"], gold.first().corpus)
    report = store.evaluate(gold)
    print(report.first())
    assert evalkit.gate(report, float(os.environ.get("GOLD_LEAST", "0.65")))[0]


def test_cli_knows_its_commands():
    with pytest.raises(SystemExit):
        cli.main(["only-a-root"])
