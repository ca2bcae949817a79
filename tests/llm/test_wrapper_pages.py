"""HTML wrappers: pages captured again, texts that articles share, the dealing of rows, long pages, and the aligner against brute force."""

import itertools
import json
import random

import pyarrow as pa
import pytest

from lakeseek.llm import common, wrapper

PAGES = "page_id long, url string, html string"


def texts(spark, rows, parts=None):
    d = spark.createDataFrame(rows, PAGES)
    return {r.page_id: r.text for r in wrapper.extract(d.repartition(parts) if parts else d).collect()}


def hosts(seed, n, distinct, again):
    """n hosts of distinct pages, some captured again; each has blocks that no other page has."""
    rng, rows = random.Random(seed), []
    for h in range(n):
        pages = []
        for i in range(distinct):
            blocks = ["<h1>Head {0}</h1>", "<p>Text {0}</p>", "<p>More {0}</p>", "<h2>Part {0}</h2>", "<table><tr><td>cell {0}</table>", "<ul><li>one {0}<li>two {0}</ul>"]
            body = "".join(b.format(f"{h} {i} {k}") for k, b in enumerate(rng.sample(blocks, rng.randrange(2, 6))))
            pages.append(f"<nav>Menu</nav><div><article>{body}</article></div>")
        pages += rng.sample(pages, again)
        rows += [(1000 * h + i, f"http://host{h}.x/", p) for i, p in enumerate(pages)]
    return rows


@pytest.mark.parametrize(("distinct", "again"), [(2, 1), (5, 2), (10, 3)])
def test_pages_captured_again_lose_nothing(spark, distinct, again):
    rows = hosts(distinct, 12, distinct, again)
    got = texts(spark, rows)
    assert got == {i: wrapper.main_text(html, None) for i, _, html in rows}
    assert all("Head" in t or "Text" in t or "More" in t or "Part" in t or "cell" in t or "one" in t for t in got.values())


def test_what_two_articles_share_stays(spark):
    rows = [(1, "http://a.x/", "<article><h1>News</h1><p>body e</p></article>"), (2, "http://a.x/", "<article><h1>News</h1><p>body f</p></article>")]
    rows += [(3, "http://b.x/", "<article><p>Common first words</p><p>Alpha</p></article>"), (4, "http://b.x/", "<article><p>Common first words</p><p>Delta Q</p></article>"), (5, "http://b.x/", "<article><p>Other</p><p>Delta Q</p></article>")]
    assert texts(spark, rows) == {1: "News body e", 2: "News body f", 3: "Common first words Alpha", 4: "Common first words Delta Q", 5: "Other Delta Q"}


def test_what_half_of_a_host_holds_is_template(spark):
    """Near copies of one article count once, so they keep their text."""
    page = "<article><p>Terms of use</p><h1>Head {0}</h1><p>A long text of this page, number {0}</p>{1}</article>"
    rows = [(i, "http://a.x/", page.format(i, "<p>Ask us</p>" if i < 2 else "")) for i in range(6)]
    rows += [(100 + i, "http://b.x/", f"<article><p>{i} o'clock</p><p>One article that was copied {'' if i % 2 else ' '} often</p></article>") for i in range(9)]
    got = texts(spark, rows)
    assert got[0] == "Head 0 A long text of this page, number 0 Ask us" and got[5] == "Head 5 A long text of this page, number 5"
    assert got[103] == "3 o'clock One article that was copied often"


def test_dealing_of_rows_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "FAN", 3)  # many levels
    monkeypatch.setattr(common, "PER_TASK", 4)
    rng = random.Random(4)
    rows = hosts(7, 6, 9, 2)
    rows = [(i, "http://hot.x/" if i % 3 == 0 else u, h.replace("<article>", f"<article><section>On every page</section><h3>What only page {len(h)} {sum(map(ord, h))} has</h3>")) for i, u, h in rows]
    want = texts(spark, rows, 1)
    assert any("On every page" in wrapper.main_text(h, None) for *_, h in rows) and not any("On every page" in t for t in want.values())
    for parts in (4, 32):
        rng.shuffle(rows)
        assert texts(spark, rows, parts) == want
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    assert texts(spark, rows, 5) == want


def test_words_of_names_in_articles(spark):
    assert wrapper.main_text("<article><div class='share-price'>12</div><section id='social-security'>Law</section><div class='social-share'>x</div><div class='comment-list'>y</div><div class='ad-2'>z</div></article>", None) == "12 Law"


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("limit", [250_000, 0])
def test_alignment_against_brute_force(monkeypatch, limit):
    """Blocks are in order, agree, and hold a common part; equal streams and streams with a part more are aligned in full."""
    monkeypatch.setattr(wrapper, "ALIGN", limit)
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.7 else [rng.choice("abcdefg") for _ in range(rng.randrange(1, 25))]
        found = wrapper._blocks(a, b)
        pairs = [(i + k, j + k) for i, j, n in found for k in range(n)]
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs)) and len({j for _, j in pairs}) == len(pairs) == len({i for i, _ in pairs}) and [j for _, j in pairs] == sorted(j for _, j in pairs)
        assert len(pairs) <= longest_common(a, b) and (bool(pairs) or not set(a) & set(b))
        assert sum(n for *_, n in wrapper._blocks(a, a)) == len(a)


def test_long_pages_lose_their_template_too(spark):
    """Streams far past ALIGN, with and without keys that come once."""
    rng = random.Random(2)
    rows = []
    for i in range(4):
        tags = [rng.choice(["p", "h2", "h3", "dt", "td"]) for _ in range(900 + 10 * i)]
        body = "".join(f"<{t}>x{i} {k}</{t}>" for k, t in enumerate(tags))
        rows.append((i, "http://long.x/", f"<main><h1>Same head</h1><p>Some words of page {i}</p>{body}<address>Same end</address></main>"))
    got = texts(spark, rows)
    assert all("Same" not in t and t.count(" ") > 900 for t in got.values())


def test_wrappers_of_many_keys_keep_the_slots_of_templates(spark):
    """Pages of over MAX_KEYS keys, in two shapes: what stands at their end is template all the same."""
    rng = random.Random(5)
    tags = [rng.choice(("p", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "table", "figure", "section", "address")) for _ in range(6_000)]
    body = "".join(f"<{t}></{t}>" for t in tags)
    assert len(wrapper.slots(wrapper.tokens(body))[0]) > wrapper.MAX_KEYS
    end = "<div>Printed from the archive</div>"
    rows = [(i, "http://long.x/", f"<article><h1>Own {i} {'text ' * 40}</h1>{'<blockquote></blockquote>' * (i % 2)}{body}{end}</article>") for i in range(6)]
    assert texts(spark, rows) == {i: f"Own {i} {'text ' * 40}".strip() for i in range(6)}


def test_keys_left_out_can_hold_no_template(monkeypatch):
    """Buckets of pages with keys of their own, two levels up: those go, and whatever half of all pages have stays, with no fewer pages than it has."""
    monkeypatch.setattr(wrapper, "MAX_KEYS", 4)
    rng, has, pages = random.Random(6), {}, []
    for i in range(256):
        keys = [k for k in range(12) if rng.random() < (0.3, 0.45, 0.55, 0.7)[k % 4]] + [100 + i]
        pages.append(" ".join([f"<s{k}>" + f" <k{k:03d}>" * (k in keys) for k in range(12)] + ["<s12>", f"<k{100 + i}>"]))  # all pages have the s, so keys of one name are one slot
        for k in keys:
            has[f"<k{k:03d}>"] = has.get(f"<k{k:03d}>", 0) + 1
    names = ["host", "bucket", "buckets", "pages", "total", "wrapper", "n", "held", "lacks"]
    merged = lambda rows: [tuple(r.values()) for b in wrapper._merge([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]) for r in b.to_pylist()]
    rows = merged(sorted(("h", i % 16, 16, 256, 256, p, 1, 1, 0) for i, p in enumerate(pages)))
    rows = merged(sorted((h, b % 4, 4, n, t, w, 0, held, lacks) for h, b, _, n, t, w, held, lacks in rows))
    [(*_, found, held, _)] = merged(sorted((h, 0, 1, n, t, w, 0, held, lacks) for h, b, _, n, t, w, held, lacks in rows))
    kept = {k: n for k, _, _, _, n in json.loads(found)}
    assert held == 256 and all(kept.get(k, 0) >= n for k, n in has.items() if 2 * n >= 256)
    assert not any(f"<k{100 + i:03d}>" in kept for i in range(256))
