"""Archives by size class: a long page doesn't decide the files of the others."""

from collections import Counter

from pyspark.sql import functions as F

from lakeseek.llm import warc


def test_one_long_page_among_long_ones(spark):
    rows = [(i, f"http://h.x/{i}", f"{i} " + "x" * 40_000) for i in range(60)] + [(99, "http://h.x/99", "y" * 40_000_000), (100, "u", "short"), (101, "u", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.capture_index(d).collect()
    assert len(got) == 63 and Counter(r.payload_bytes for r in got) == Counter(len((h or "").encode()) for *_, h in rows)
    assert len({r.run for r in got}) == 3  # short, up to 64 KB, the long one


def test_size_classes(spark):
    sizes = [0, warc.LONG, warc.LONG + 1, 2 * warc.LONG, 2 * warc.LONG + 1, 4 * warc.LONG, 2**31 - 1]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select(warc.size_class(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [0, 0, 1, 1, 2, 2, 16]
