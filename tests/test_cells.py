"""Nearest neighbours over stored cells, and excerpts, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.functions import terms as T
from lakeseek.operators import excerpt, vector

VECTORS, QUERIES = "chunk_id string, corpus string, embedding array<float>", "qid string, corpus string, embedding array<double>"


def hits(df):
    return sorted((r.qid, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def clustered(n, centres=12, d=16, noise=0.03, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(f"v{i:05}", "xy"[i % 2], (c[i % centres] + noise * rng.normal(size=d)).tolist()) for i in range(n)]


def test_cells_give_the_hits_of_all_rows(spark, tmp_path):
    """Other lengths, zero vectors, values that are no numbers, nulls, a third of the rows one vector; queries of a corpus with fewer than k rows, of other lengths and zero."""
    rows = clustered(900)
    rows += [(f"hot{i:04}", "x", [0.5] * 16) for i in range(450)] + [("zero", "x", [0.0] * 16), ("short", "y", [1.0, 2.0]), ("rare", "z", [0.1] * 16), ("none", "x", None), ("empty", "x", []), ("nocorpus", None, rows[3][2])]
    v = spark.createDataFrame(rows, VECTORS).repartition(7)
    asked = [(f"q{i}", "", rows[i][2]) for i in range(0, 900, 90)] + [("hot", "x", [0.5] * 16), ("few", "z", rows[5][2]), ("nobody", "w", rows[5][2]), ("short", "", [1.0, 2.0]), ("zero", "", [0.0] * 16), ("null", "", None), ("away", "y", (-np.array(rows[7][2])).tolist())]
    q = spark.createDataFrame(asked, QUERIES)
    cells = vector.cluster(v, str(tmp_path / "cells"))
    assert hits(vector.nearest(cells, q, 9)) == hits(vector.search(v, q, 9))
    again = vector.load_cells(spark, str(tmp_path / "cells"), v.schema)
    assert hits(vector.nearest(again, q, 3)) == hits(vector.search(v, q, 3))
    assert cells.rows.count() == len(rows) - 2 == cells.balls.groupBy().sum("n").first()[0]
    assert {r.chunk_id for r in cells.rows.where("cell = -1").collect()} == {"zero", "short"}


def test_cells_leave_rows_out(spark):
    """In clustered vectors a query meets a part of the cells; the files of the others aren't read."""
    rows = clustered(3000, centres=30, noise=0.01)
    v, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame([(r[0], "", r[2]) for r in rows[:20]], QUERIES)
    cells = vector.cluster(v)
    shares = vector.pruning(cells, q, 5).collect()
    assert len(shares) == 20 and all(r.rows == 3000 and r.met < 600 and r.kept < r.cells for r in shares)
    assert hits(vector.nearest(cells, q, 5)) == hits(vector.search(v, q, 5))


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold(seed):
    """No row of a ball scores more than the bound."""
    rng = np.random.default_rng(seed)
    for d in (2, 3, 40):
        m = vector._unit(rng.normal(size=(300, d)) + (seed == 2) * 5)
        p = m[:6]
        near = m @ p.T
        cell = near.argmax(axis=1)
        balls = [{"cell": j, "pivot": p[j].tolist(), "radius": float(np.arccos(np.clip(near[cell == j, j], -1, 1)).max())} for j in range(6)] + [{"cell": -1, "pivot": None, "radius": 0.0}]
        block = [{"embedding": e} for e in rng.normal(size=(50, d)).tolist() + m[:50].tolist()] + [{"embedding": [0.0] * d}, {"embedding": [1.0] * (d + 1)}]
        bound = vector._bounds(block, balls)
        assert (bound[:, 6] == 2).all() and (bound[-2:] == 2).all()
        q = vector._unit(np.array([b["embedding"] for b in block[:100]]))
        for j in range(6):
            assert (bound[:100, j, None] >= q @ m[cell == j].T - vector.SLACK).all()


def test_no_rows_no_queries(spark):
    v, q = spark.createDataFrame([], VECTORS), spark.createDataFrame([("a", "", [1.0])], QUERIES)
    assert hits(vector.nearest(vector.cluster(v), q)) == []
    some = vector.cluster(spark.createDataFrame([("a", "x", [1.0, 0.0])], VECTORS))
    assert hits(vector.nearest(some, q.limit(0))) == [] and hits(vector.nearest(some, q)) == [("a", 1, "a", 1.0)]


# --- excerpts, sentence by sentence in plain Python


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower().translate(str.maketrans(".,;!?", "     ")).strip(" ")) if w and w not in T.SNIPPET_STOPWORDS]


def parts(t):
    found = [x.strip(" ") for x in t.split(". ")]
    return [x for x in found if x and not re.search(r"^ARTICLE[ \t\n\x0b\f\r]+(?:PREMIER|[0-9]+)\.?[ \t\n\x0b\f\r]*$", x, re.I)]


def trim(t, n):
    return t[:n] + "..." if len(t) > n else t


def pack(found, budget):
    out = []
    for x in found:
        if len(out) == 3 or len(". ".join([*out, x])) > budget:
            break
        out.append(x)
    return ". ".join(out)


def legal(t, limit):
    if len(t) <= limit:
        return t
    head = t[:1200]
    budget = limit - len(head) - 2
    tail = pack([x for x in parts(t) if any(p in x.lower() for p in T.PRIORITY_TERMS) and x.lower() not in head.lower()], budget)
    return trim(head + "\n\n" + tail, limit) if budget > 80 and tail else trim(t, limit)


def plain(t, query):
    t = t.strip(" \t\r\n")
    articles = re.search(r"^ARTICLE[ \t\n\x0b\f\r]+(?:PREMIER|[0-9]+)", t, re.I | re.M)
    if len(t) <= (2200 if articles else 900):
        return t
    if articles:
        return legal(t, 2200)
    asked = {w for w in words(query) if w != "article"}
    if not asked:
        return trim(t, 900)
    scored = [(-(sum(w in asked for w in words(x)) + sum(p in x.lower() for p in T.PRIORITY_TERMS)), -len(x), x) for x in parts(t)]
    best = [x for n, _, x in sorted(scored, key=lambda s: (s[0], s[1], s[2].encode())) if n < 0]
    if not best:
        return legal(t, 900)
    return trim(best[0], 900) if len(best[0]) > 900 else pack(best, 900)


def check(spark, rows):
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, q string").select("i", excerpt.excerpt(F.col("t"), F.col("q"), F.lit("")).alias("e")).collect()
    for r in got:
        assert r.e == plain(*rows[r.i]), rows[r.i]


def test_excerpts_of_all_documents(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text is not None]
    check(spark, [(t, " ".join(t.split()[len(t) % 7 : len(t) % 7 + 4])) for t in docs])


def test_excerpts_of_hostile_texts(spark):
    """Terms inside longer words, repeated words side by side, tabs and marks between words, sentences of headings only, equal scores."""
    rng = random.Random(3)
    bits = ["la", "Élection", "présidentielle", "presidentielle", "président PRESIDENT", "ΣΑΣ", "les", "baleine", "Baleine", "baleine baleine", "baleineau", "is", "article", "ARTICLE 5", "\nARTICLE 16. ", "dissoute,", "a\tb", "x;y", "...", ". ", ". ", "!", "\r\n", "urgence?", "report"]
    rows = []
    for _ in range(300):
        t = " ".join(rng.choices(bits, k=rng.choice([5, 200, 600])))
        rows.append((t, " ".join(rng.choices(bits, k=rng.randrange(0, 5)))))
    check(spark, rows)
