"""python -m lakeseek.jobs.cli ROOT COMMAND ...

ingest-dir FOLDER [CORPUS] | sync-dir FOLDER [CORPUS] | delete ID... | compact | reset | stats | manifest | query TEXT [CORPUS]
eval GOLD [REPORT [LEAST]] | eval-excerpt GOLD | eval-generation GOLD ANSWERS | bench QUERIES

GOLD: JSON lines; ANSWERS: JSON lines of id and answer; QUERIES: a query a line.
eval ends with 1 where the recall is below LEAST. What a command has written for itself
is removed when it is done. bench prints query, milliseconds, hits and titles as CSV, one query after the other.
"""

from __future__ import annotations

import csv
import sys
import time

from pyspark.sql import SparkSession

from ..operators import evalkit
from ..session import remove_written
from ..sources import files
from .engine import Engine

_QUERY = "qid int, text string, corpus string"


def bench(engine: Engine, queries: list[str], out) -> None:
    """A line of CSV for each query: text, milliseconds until the hits are there, how many, and their documents' titles."""
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow(["query", "latency_ms", "hits", "doc_titles"])
    for text in queries:
        began = time.perf_counter()
        hits = engine.retrieve(engine.spark.createDataFrame([(0, text, "")], _QUERY)).orderBy("rank").collect()
        lines.writerow([text, round(1000 * (time.perf_counter() - began)), len(hits), "; ".join(dict.fromkeys(h["doc_title"] for h in hits))])


def main(args: list[str]) -> int:
    if len(args) < 2:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("lakeseek").getOrCreate()
    engine, (command, *rest), code = Engine(spark, args[0]), args[1:], 0
    if command == "ingest-dir":
        engine.ingest(files.read_directory(spark, *rest))
    elif command == "sync-dir":
        print(engine.sync_directory(*rest))
    elif command == "delete":
        print(engine.delete(rest))
    elif command in ("compact", "reset"):
        getattr(engine, command)()
    elif command == "query":
        q = spark.createDataFrame([(0, rest[0], rest[1] if len(rest) > 1 else "")], _QUERY)
        engine.retrieve(q).orderBy("rank").show(truncate=False)
    elif command == "eval":
        done = engine.evaluate(files.read_gold(spark, rest[0]), path=rest[1] if len(rest) > 1 else None)
        done.show()
        if len(rest) > 2 and not evalkit.gate(done, float(rest[2]))[0]:
            code = 1
    elif command == "eval-excerpt":
        engine.evaluate_excerpts(files.read_gold(spark, rest[0])).show(truncate=False)
    elif command == "eval-generation":
        evalkit.phrase_cases(spark.read.schema("id string, answer string").json(rest[1]), files.read_gold(spark, rest[0])).show(truncate=False)
    elif command == "bench":
        bench(engine, [r["value"] for r in spark.read.text(rest[0]).where("trim(value) <> ''").collect()], sys.stdout)
    elif command == "stats":
        engine.stats().show()
    elif command == "manifest":
        print(engine.manifest(), *engine.warnings(), sep="\n")
    else:
        sys.exit(__doc__)
    remove_written(spark)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
