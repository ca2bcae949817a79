"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeseek.llm import chat, decontaminate, lmscore, mixing, quality, simhash, tokencount, toxicity, warc, wrapper
from lakeseek.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2.0) for i, t, s in rows], DOCS)


def mixed(spark):
    """Nulls, an empty and a very long text, repeated rows and ids, and columns whose names clash."""
    return docs(spark, [(None, "a b c d", None), (None, None, "x"), (1, "", "x"), (2, LONG, "x"), (3, "same text here now", "y"), (3, "same text here now", "y"), (4, "same text here now", None), (4, "other words", "")])


def components(rows):
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3), strict=True):
        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash_equals_brute_force(spark):
    rng, rows = random.Random(1), []
    base = [rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(400)]
    for i in range(120):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice(base) for _ in range(rng.randrange(9)))) for i in range(60)] + [(None, None), (None, "A b"), (7, "a B"), (7, "a B")]
    got = simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    want = components(rows)
    assert len({c for _, _, c in want}) < len(want)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_simhash_finds_every_link_of_three_bits(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 1 + k % 3)) for k, f in enumerate(fps)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    old, simhash.BLOCK = simhash.BLOCK, 2  # anchors of many are dealt out
    try:
        edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
        found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in edges}
    finally:
        simhash.BLOCK = old
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    assert all(tuple(sorted((f, g))) in found for f, g in zip(fps[:300], fps[300:], strict=True))


def test_simhash_broadcasts_no_anchors(spark, tmp_path):
    """32 rows a fingerprint are as many bytes to the planner as the file they come from: under the threshold, so the driver got them all."""
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan


def test_near_duplicate_stage_keeps_one_row_each(spark):
    got = simhash.drop_near_duplicates(mixed(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter([None, 1, 2, 3, 4][:0] + [r for r in (None, 1, 2, 3, 4)])
    assert set(mixed(spark).columns) == set(got[0].asDict())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|><|im_start|>assistant \\ok <\\|"), (1, 1, "assistant", None), (1, 2, "assistant", "b\n<|im_sep|>"), (1, 3, "user", ""), (2, None, None, "x"), (None, 5, "a\nb", "y"), (1, 3, "user", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("t", chat.parse_chats(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("user", rows[0][3]), ("assistant", ""), ("assistant", "b\n<|im_sep|>"), ("user", ""), ("user", "")]
    assert [(t.role, t.text) for t in got[2].t] == [("", "x")] and [(t.role, t.text) for t in got[None].t] == [("a\nb", "y")]
    assert "".join(p.text for p in got[1].pieces) == got[1].formatted and got[1].formatted.count("<|im_start|>assistant") == 1
    assert "".join(p.text for p in got[1].pieces if p.loss) == "b\n<\\|im_sep|>"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxicity_learns_one_row_of_a_repeated_id(spark):
    rows = [(i, f"you idiot {i}" if i % 2 else f"good day {i}", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once, often = (toxicity.train(docs(spark, x), labels) for x in (rows, rows + rows[:7] * 30))
    assert once.any() and (once == often).all()


def test_toxicity_holds_out_and_learns(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["vile", "scum"] if i % 4 == 0 else [])), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows + [(None, None, None), (9999, "", "s")]), labels).collect()
    assert len(got) == 602
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(mixed(spark), labels.where("false")).where("score <> 0.5").count() == 0


def test_token_counts_are_the_library_s(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=public.path(tokencount.MODEL)), tokencount.counter()
    rng = random.Random(4)
    parts = ["the ", " ", "  ", "\n", "\t", "▁", "Ünï", "中文", "😀", "<s>", "</s>", "\x00", "a", ".", ",x"]
    monkeypatch = pytest.MonkeyPatch()
    for i in range(1500):
        monkeypatch.setattr(tokencount, "STRETCH", 2 if i % 2 else 200_000)
        t = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert c.count(t) == len(sp.encode(t)), repr(t)
        want, budget = [len(sp.encode(t[:i])) for i in range(len(t) + 1)], rng.randrange(1, 9)
        fits = max(i for i, n in enumerate(want) if n <= budget)
        assert c.prefix_counts(t).tolist() == want, repr(t)
        assert c.fit(t, budget) == (want[-1], fits) and c.truncate(t, budget) == (t[:fits], want[fits]), repr(t)
    monkeypatch.undo()
    for long in ("".join(rng.choices("abcdefgh", k=60_000)), "z" * 60_000, " " * 60_000, "é中" * 20_000):  # atoms without a cut
        assert c.count(long) == len(sp.encode(long)) and c.prefix_counts(long)[30_001] == len(sp.encode(long[:30_001]))
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in rows.collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(rows).collect()} == want
    short, whole = tokencount.truncate_to_budget(rows, 7).collect(), {r.doc_id: r.text or "" for r in rows.collect()}
    assert all(r.n_tokens <= 7 and r.n_tokens == len(sp.encode(r.text)) and whole[r.doc_id].startswith(r.text) for r in short)
    fit = {r.doc_id: r.fit_chars for r in tokencount.token_counts(rows, 7).collect()}
    assert fit == {r.doc_id: len(r.text) for r in short}
    assert {r.doc_id: r.counts[-1] for r in tokencount.prefix_table(rows).collect()} == want
    assert tokencount.prefix_table(mixed(spark)).count() == 8 and tokencount.truncate_to_budget(mixed(spark).where("false"), 3).count() == 0
    assert [r.n_tokens for r in tokencount.token_counts(docs(spark, [(1, None, None), (2, "", None)])).collect()] == [0, 0]


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})


def test_quality_equals_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x y z " * 30, "#" * 60, "l\nl\n\nl", LONG, "a  b\x0bc", "é|<> " * 60, "a b c d a b c"]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "1L AS fp", "2D AS score"))
    want = {r.doc_id: measures(r.text) for r in rows.collect()}
    got = quality.quality(rows).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert {r.doc_id for r in quality.keep_good(rows).collect()} == {r.doc_id for r in got if r.kept}
    assert sorted(r.name for r in quality.order_rules(rows)) == sorted(r.name for r in quality.RULES)


@pytest.mark.parametrize("bits", [2, 20, 58, 62])
def test_repeated_words_are_exact_where_hashes_collide(spark, bits):
    """Hashes cut to few bits collide at once; a text longer than the places takes the exact way."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    got = {r.text: r.n for r in rows.select("text", F.expr(quality.repeat_words(bits)).alias("n")).collect()}
    assert got == {t: measures(t)[4] for t in texts}


def test_repeated_words_of_a_very_long_text(spark):
    """Over 2^20 words; the same windows stand a million words apart."""
    t = "same three words " + " ".join(map(str, range(1_048_600))) + " same three words"
    row = docs(spark, [(1, t, "s"), (2, "same three words " * 2, "s")])
    got = {r.doc_id: r for r in quality.quality(row).collect()}
    assert got[1].n_words == 1_048_606 and got[1].n_repeat_words == 6 and got[2].n_repeat_words == 6


def test_cascade_orders_by_rejections_per_cost(spark):
    """A rule that rejects what another leaves goes before one whose rejections the first has already."""
    rules = (quality.Rule("never", "n_words < 0"), quality.Rule("half", "n_words < 2"), quality.Rule("same", "n_words < 2 OR n_repeat_words < 0"), quality.Rule("rest", "n_words >= 2"))
    rows = docs(spark, [(i, "a b c" if i % 2 else "a", "s") for i in range(200)])
    order = [r.name for r in quality.order_rules(rows, rules=rules)]
    assert order.index("half") < order.index("never") and order.index("rest") < order.index("never")
    plain = docs(spark, [(1, "x y " * 40 + "z", "s"), (2, None, "s"), (2, None, "s")]).withColumnRenamed("text", "a`b").withColumn("n_words", F.lit(1)).withColumn("t", F.lit("z")).withColumn("m", F.lit(0))
    assert [r.name for r in quality.order_rules(rows.where("false"), rules=rules)] == [r.name for r in rules]
    assert quality.keep_good(plain, "a`b").columns == plain.columns and quality.keep_good(plain, "a`b").count() == 0


def test_quality_runs_no_python(spark):
    plan = quality.quality(mixed(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = '<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>H&amp;M</h1><p>One  <b>two</b>three<br>four<p>Five<div class="comments">No</div></article><footer>F</footer>'


def test_main_text(spark):
    assert wrapper.main_text(PAGE, None) == "H&M One twothree four Five"
    assert wrapper.main_text("<p>a < b &lt; c", None) == "a < b < c"
    assert wrapper.main_text(None, None) == "" and wrapper.main_text("<nav>x</nav>", None) == ""
    bare = [(i, "http://h.x/", f'<body><div>Our site</div><p>Text {i}</p><p>More {i} {"and" * i}</p><div>All rights</div></body>') for i in range(6)] + [(9, None, None), (10, "http://h.x/", PAGE)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert got[2] == "Text 2 More 2 andand" and got[9] == "" and got[10] == "H&M One twothree four Five"


@pytest.mark.parametrize("around", ["div class='content with-sidebar'", "div class='no-sidebar'", "div id='page-widget'", "form action='/'", "section class='share_menu' role=''"])
def test_layout_containers_keep_their_article(around):
    tag = around.split()[0]
    page = f"<{around}><div class='ad'>Buy</div><article><h1>Head</h1><p>Text</p><div class='comments'>No</div></article><aside>Side</aside></{tag}>"
    assert wrapper.main_text(page, None) == "Head Text"
    assert wrapper.main_text(page + "<div class='related'><article>Other</article></div>", None).startswith("Head Text")
    assert wrapper.main_text("<main><p>Main</p></main><div class='related-posts'><article>Other</article></div>", None) == "Main"


def test_wrapper_decides_in_articles(spark):
    """What all articles of a host hold is template; a host of copies keeps its text, and so does one of two pages."""
    page = "<nav>Menu {0}</nav><article><div>Read our terms</div><h1>Head {0}</h1><p>Text {0}</p><div>All rights</div></article>"
    rows = [(i, "http://h.x/", page.format(i)) for i in range(4)] + [(10 + i, "http://copy.x/", page.format(0)) for i in range(3)]
    rows += [(20 + i, "http://list.x/", f"<ul><li>a{i}<li>b</ul><ul><li>c<li>d{i}</ul><p>End</p><h2>x</h2>") for i in range(2)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Head 2 Text 2" and got[11] == "Read our terms Head 0 Text 0 All rights" and got[21] == "a1 b c d1 End x"


def test_wrapper_finds_the_text_of_generated_templates(spark):
    """Hosts whose templates name nothing: no article, classes without meaning, fixed text before, after and among the paragraphs, some of it on some pages only."""
    rng, rows, want = random.Random(11), [], {}
    tags = ["div", "section", "span", "td"]
    for h in range(6):
        top, low, box = rng.choice(tags[:2]), rng.choice(tags[:2]), f"c{rng.randrange(999)}"
        for i in range(8):
            paragraphs = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(9999)) for _ in range(12)) for _ in range(rng.randrange(1, 6))]
            advert = f'<{low} class="{box}">Buy our things of house {h}</{low}>' if i % 2 else ""
            body = "".join(f"<p>{p}</p>" for p in paragraphs)
            page = f"<html><body><{top} class=k{h}><a href=/>House {h}</a><a href=/x>All pages</a></{top}><h1>Head {h} {i}</h1>{advert}{body}<{low} id=z>Written by house {h}</{low}></body></html>"
            rows.append((100 * h + i, f"http://host{h}.x/{i}", page))
            want[100 * h + i] = " ".join([f"Head {h} {i}", *paragraphs])
    rows.append((999, "http://alone.x/", "<body><div>Only page</div><p>Its text</p></body>"))
    want[999] = "Only page Its text"  # nothing to compare with
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_pages_of_awkward_tables(spark):
    """Hostile and very long pages in linear time, repeats, nulls, clashing columns, an empty table."""
    long = "<div>" * 8000 + "</x>" * 8000 + "<p>end</p>"
    rows = [(1, "http://a.x/", long), (1, "http://a.x/", long), (None, None, None), (2, "http://b.x/", "<" * 20_000 + "<p>t"), (3, "http://c.x/", "<main>" + "<p>word</p>" * 20_000 + "</main>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("host", F.lit("mine")).withColumn("wrapper", F.lit("mine"))
    got = Counter((r.page_id, r.text[:20], r.n_chars) for r in wrapper.extract(d).collect())
    assert got[(1, "end", 3)] == 2 and got[(None, "", 0)] == 1 and got[(3, "word word word word ", 99_999)] == 1 and sum(got.values()) == 5
    assert wrapper.extract(d.where("false")).count() == 0


def test_warc_bounds_archives_and_keeps_long_payloads(spark, monkeypatch):
    """Long payloads in files of their own, few records a file; clashing columns and repeated rows do no harm."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    monkeypatch.setattr(warc, "STRETCH", 2)
    rows = [(i, f"http://h{i % 3}.x/{i % 5}", ("long é " * 40_000 if i % 4 == 0 else f"page {i % 6}")) for i in range(23)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).withColumn("run", F.lit("mine"))
    got = warc.capture_index(d).collect()
    assert len(got) == 46 and Counter(r.payload_bytes for r in got) == Counter(len(t.encode()) for _, _, t in rows)
    by_run = Counter(r.run for r in got)
    assert max(by_run.values()) <= 2 or max(r.payload_bytes for r in got) * max(by_run.values()) <= warc.FILE_BYTES
    order = [(r.urlkey, r.ts, r.page_id) for r in sorted(got, key=lambda r: (r.index_part, r.index_place))]
    assert order == sorted(order)


def test_chats_of_awkward_tables(spark):
    long = "<|im_end|>\\" * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("formatted", "pieces", "t", "m", "s"):
        d = d.withColumn(name, F.lit("mine"))
    got = chat.format_chats(d).withColumn("back", chat.parse_chats(F.col("formatted"))).collect()
    assert [(x.role, x.text) for x in got[0].back] == [("user", long), ("assistant", long), ("assistant", long)] and len(got) == 1


def test_wrapper_folds_repeats_and_optionals():
    def of(html):
        keys, rep, _, text = wrapper.slots(wrapper.tokens(html))
        return wrapper.as_wrapper(keys, rep, text)

    a, b = of("<ul><li>1<li>2<li>3</ul><p>x</p>"), of("<ul><li>1</ul><h2>t</h2><p>y</p>")
    w = wrapper.align(a, b)
    assert any(x[1] for x in w) and [x[0] for x in w if x[2]] and [x[3] for x in w if x[0] == "#o"][-1] == -1


def test_warc_round_trip_and_order(spark):
    same = "<p>é</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://b.x/q", same), (3, "http://b.x/q", same), (9, "https://a.x/\r\n", same), (4, "u", None), (6, "", ""), (7, None, "z"), (None, "http://c.x", "n"), (7, None, "z")]
    got = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((t or "").encode()), digest(t), "revisit" if i in (5, 9, 6) else "response", {5: 3, 9: 3, 6: 4}.get(i)) for i, _, t in rows]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    order = [(r.urlkey, r.ts, r.page_id or 0) for r in sorted(got, key=lambda r: (r.index_part, r.index_place))]
    assert order == sorted(order)
    big = spark.createDataFrame([(i, "u", "ab") for i in range(3)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.capture_index(big, min_payload=3).collect()} == {"response"}
    assert warc.capture_index(big.where("false")).count() == 0


def test_loser_tree_merges():
    rng = random.Random(5)
    for k in range(9):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies <= 3 and r.taken == r.copies * r.size and r.source_size
    names = sorted((s for s in size if s is not None)) + [None]
    want, free, left = {}, dict(zip(names, (5, 2, 1) * 2, strict=False)), float(sum(size.values()))
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * size[s]]
        for s in over or list(free):
            want[s] = 3.0 * size[s] if over else level * free[s]
            if over:
                left -= want[s]
            del free[s]
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in names)
    assert all(abs(taken[s] - target[s]) <= max(60, 0.01 * target[s]) for s in names)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs(spark, rows).repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert mixing.mix(docs(spark, rows).where("false")).count() == 0 and mixing.mix(mixed(spark)).count() == 8


def tiles(doc, item, k):
    """Greedy string tiling by trying all places."""
    md, mi = [False] * len(doc), [False] * len(item)
    while True:
        best, at = k - 1, []
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and doc[d + n] == item[p + n] and not md[d + n] and not mi[p + n]:
                    n += 1
                if n > best:
                    best, at = n, [(d, p)]
        if not at:
            return sum(mi)
        d, p = at[0]
        for j in range(best):
            md[d + j] = mi[p + j] = True


@pytest.mark.parametrize("seeds", [decontaminate.SEEDS, 3])
def test_tiling_equals_brute_force(spark, monkeypatch, seeds):
    """Ties too: the first in the document, then in the item. Items under a tile are met whole; seeds go through in stretches."""
    monkeypatch.setattr(decontaminate, "SEEDS", seeds)
    rng = random.Random(7)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(rng.randrange(1, 16))]
        doc = [rng.choice("abcde") for _ in range(rng.randrange(0, 25))] + item[5:] + ["z"] + item[:5]
        got = dict(decontaminate.Index([(1, " ".join(item))], 4).hits(" ".join(doc), 1e-9)).get(1, 0) * len(item)
        assert round(got) == tiles(doc, item, min(4, len(item))), (item, doc)
    assert decontaminate.Index([(1, "a " * 2000)]).hits("a " * 2000) == [(1, 1.0)] and decontaminate.Index([]).hits("a b c d") == []
    words = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (None, "x"), (3, None)], "item_id long, text string")
    moved = "start " + " ".join(words[20:]).upper() + ", middle. " + " ".join(words[:20])
    rows = docs(spark, [(1, moved, "s"), (2, " ".join(words[:15]), "s"), (3, None, "s"), (4, "", "s"), (5, "is too short", "s"), (1, moved, "s")])
    got = {r.doc_id: r for r in decontaminate.decontaminate(rows, bench).collect()}
    assert got[1].contaminated and got[1].item_ids == [1] and got[1].coverage == 1.0 and got[5].item_ids == [2]
    assert not any(got[i].contaminated for i in (2, 3, 4)) and got[2].best_item is None
    blocks = Counter((r.doc_id, tuple(h.item_id for h in r.found)) for r in decontaminate.with_hits(rows, bench, "found", block_chars=5).collect())
    assert blocks == Counter({(1, (1,)): 2, (2, ()): 1, (3, ()): 1, (4, ()): 1, (5, (2,)): 1})


def clashing(df):
    """df with columns of names that stages use inside."""
    for name in ("__hits", "__toxic", "__row", "__key", "__th", "__none", "__order", "__x", "__y", "__more", "n_words", "m", "t", "rank", "target", "hits"):
        df = df.withColumn(name, F.lit("mine"))
    return df


STAGE = {
    "toxicity": lambda s, d: toxicity.drop_toxic(d, s.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")),
    "quality": lambda s, d: quality.keep_good(d),
    "near_duplicates": lambda s, d: simhash.drop_near_duplicates(d),
    "decontamination": lambda s, d: decontaminate.drop_contaminated(d, s.createDataFrame([(1, "same text here now"), (None, "x")], "item_id long, text string")),
    "decontamination in blocks": lambda s, d: decontaminate.with_hits(d, s.createDataFrame([(1, "same text here now"), (2, "other things here")], "item_id long, text string"), "found", block_chars=5).where("size(found) = 0").drop("found"),
}


@pytest.mark.parametrize("name", sorted(STAGE))
def test_stages_keep_columns_and_awkward_rows(spark, name):
    """Nulls, empty and very long texts, repeats and clashing names; empty tables."""
    d = clashing(mixed(spark))
    got = STAGE[name](spark, d)
    want = {"toxicity": [None, None, 1, 2, 3, 3, 4, 4], "quality": [], "near_duplicates": [None, 1, 2, 3, 4]}.get(name, [None, None, 1, 2, 4])
    assert got.columns == d.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all(r["__row"] == r["hits"] == "mine" for r in got.collect())
    assert STAGE[name](spark, d.where("false")).count() == 0


def test_near_duplicate_stage_without_broadcast(spark, monkeypatch):
    """Keys of what goes joined by shuffle; rows equal in id and text become one, whatever else they hold. Ids repeat here, so components share names."""
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", -1)
    rows = docs(spark, [(i % 50, f"text {i % 30} of its own", "a" if i % 2 else "b") for i in range(200)])
    got = sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(rows).collect())
    monkeypatch.undo()
    assert got == sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(rows).collect())
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    assert Counter(tuple(r)[:3] for r in simhash.near_duplicates(rows).collect()) == components(pairs)
    prints = {simhash.fingerprint(t) for _, t in pairs}
    assert len(got) == len(prints) == 30 and {i for i, _ in got} == {c for _, _, c in components(pairs)}


def test_ftrl_equals_a_loop_over_coordinates():
    rng, model = random.Random(9), toxicity.Ftrl(alpha=0.7, beta=0.9, l1=0.3, l2=0.2)
    z, n = Counter(), Counter()
    for _ in range(300):
        at, y = sorted(rng.sample(range(40), 7)), float(rng.random() < 0.4)
        w = {i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - (0.3 if z[i] > 0 else -0.3)) / ((0.9 + n[i] ** 0.5) / 0.7 + 0.2) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.7 * w[i]
            n[i] += g * g
        model.learn(np.array(at), y)
    assert all(abs(model.z[i] - z[i]) < 1e-9 and abs(model.n[i] - n[i]) < 1e-9 for i in range(40))
    assert not (model.weights(np.arange(40)) == 0).all()


def test_toxicity_scores_equal_weights_by_hand(spark):
    """A score is the logistic of the bias and the weights of a text's different features."""
    rows = docs(spark, [(i, f"you vile scum {i}" if i % 3 == 0 else f"a fine day {i}", "s") for i in range(90)] + [(None, None, "s"), (200, LONG, "s")])
    w = toxicity.train(rows, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int"))
    for r in rows.withColumn("p", toxicity.scorer(spark, w)(F.col("text"))).collect():
        slots = {0, *toxicity.features(r.text).tolist()}
        assert abs(r.p - 1 / (1 + np.exp(-sum(float(w[i]) for i in slots)))) < 1e-9


@pytest.mark.parametrize("block", [lmscore.BLOCK, 7, 1])
def test_lm_scores_equal_brute_force(spark, block):
    """With one block, some, and one a document; repeated rows, null ids and texts among them."""
    rows = [(1, "good words here good words", "s"), (2, "bad noise bad noise there", "s"), (3, None, None), (4, "", "s"), (1, "good words here", "s"), (5, "one two, Three", None), (5, "one two, Three", None), (None, "here here", "s")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    cut = {i: ["<s>", *re.findall("[a-z]+", (t or "").lower()), "</s>"] for i, (_, t, _) in enumerate(rows)}
    cut = {i: w for i, w in cut.items() if len(w) > 2}
    size = len({x for w in cut.values() for x in w}) + 1

    def bits(mine, w):
        ones, pairs = Counter(x for m in mine for x in m), Counter(p for m in mine for p in zip(m, m[1:], strict=False))
        total, out = sum(n for x, n in ones.items() if x != "<s>"), 0.0
        for a, b in zip(w, w[1:], strict=False):
            one = (ones[b] + lmscore.ADD) / (total + lmscore.ADD * size)
            out -= np.log2(lmscore.MIX * pairs[a, b] / ones[a] + (1 - lmscore.MIX) * one if ones[a] else one)
        return round(out / (len(w) - 1), 6)

    want = Counter()
    for i, (d, _, _) in enumerate(rows):
        w, target = cut.get(i), [x for j, x in cut.items() if rows[j][0] == 1]
        want[(d, len(w) - 2, bits(target, w), bits(cut.values(), w)) if w else (d, 0, 0.0, 0.0)] += 1
    got = lmscore.lm_scores(docs(spark, rows), labels, block).collect()
    assert Counter((r.doc_id, r.n_words, round(r.target_bits, 6), round(r.background_bits, 6)) for r in got) == want
    assert max(r.score for r in got if r.doc_id == 1) < min(r.score for r in got if r.doc_id == 2)


def test_lm_scores_keep_every_word_above_a_million_tokens(spark):
    """A word seen twice among more than 2^20 tokens has its own counts, and how blocks are cut changes no score."""
    common = " ".join(["w"] * 110_000)
    rows = [(i, common, "s") for i in range(10)] + [(20, "rareone raretwo rareone", "s"), (21, "rarethree w rarefour", "s"), (22, "rarethree w", "s")]
    labels = spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int")
    got = lmscore.lm_scores(docs(spark, rows), labels)
    some = {r.doc_id: r for r in got.collect()}
    n, size = 1_100_000 + 8 + 13, 5 + 3
    one = lambda c, total: (c + lmscore.ADD) / (total + lmscore.ADD * size)
    loss = lambda pair, before, c, total: -np.log2(lmscore.MIX * pair / before + (1 - lmscore.MIX) * one(c, total))
    steps = [(1, 13, 2), (1, 2, 1), (1, 1, 2), (1, 2, 13)]
    assert abs(some[20].background_bits - sum(loss(*x, n) for x in steps) / 4) < 1e-6
    assert abs(some[20].target_bits - sum(loss(*x, 4) for x in [(1, 1, 2), (1, 2, 1), (1, 1, 2), (1, 2, 1)]) / 4) < 1e-6
    assert max(abs(some[r.doc_id].score - r.score) for block in (1, 100_000) for r in lmscore.lm_scores(docs(spark, rows), labels, block).collect()) < 1e-8


@pytest.mark.parametrize("block", [10_000, 500])
def test_lm_scores_do_not_depend_on_blocks(spark, block):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows.unionByName(rows.limit(20))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flat = lambda df: sorted((r.doc_id, r.n_words, r.target_bits, r.background_bits) for r in df.collect())
    for a, b in zip(flat(lmscore.lm_scores(rows, labels)), flat(lmscore.lm_scores(rows, labels, block)), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-7)


def test_lm_scores_of_awkward_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lmscore.lm_scores(mixed(spark), labels).count() == 8 and lmscore.lm_scores(mixed(spark).where("false"), labels).count() == 0


@pytest.mark.parametrize("f", [simhash.near_duplicates, tokencount.token_counts, quality.quality, mixing.mix])
def test_awkward_rows_each_give_a_row(spark, f):
    assert f(mixed(spark)).count() == 8 and f(mixed(spark).where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_their_tables(spark, name):
    got, whole = QUERIES[name](spark, SF), {"op1_warc": "pages", "op8_html": "pages", "op13_url_filters": "pages"}.get(name, "documents")
    if name in ("op11_filter_audit", "op12_conversation_trie"):  # a row for each step of each part, or for each node
        table = spark.read.parquet(f"{SF}/{'documents' if name == 'op11_filter_audit' else 'conversations'}.parquet")
        assert got.count() == 600 * table.select("lang").distinct().count() if name == "op11_filter_audit" else got.where("depth = 0").first().n_convs == table.select("conv_id").distinct().count()
        return
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1 if name == "op4_chat" else spark.read.parquet(f"{SF}/{whole}.parquet").count()
    assert got.count() == n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    sf, con = SF.replace("sf0.001", "sf0.01"), duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(want.select(*cols).fetchall())


def test_pipeline_equals_its_stages_by_hand(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(d, labels).where("predicted = 1").collect()}
    good = {r.doc_id for r in quality.quality(d).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in d.collect() if r.doc_id not in toxic and r.doc_id in good]
    kept = {i for i, _, c in components(rows) if i == c}
    index = decontaminate.Index([tuple(r) for r in bench.select("item_id", "text").collect()])
    want = {i for i, t in rows if i in kept and not index.hits(t)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.size for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows if i in want}
