"""Main text of web pages by wrappers: union-free regular expressions over token streams.

A page is a stream of tags and text slots; tandem repeats fold into repeated groups. The
shapes of a host's pages, their streams without the texts, are aligned one after the
other, and up a tree where there are many: what only some have becomes optional. That
wrapper gives each text of a page its slot, over pages. A text that half of the host's
pages or more hold in one slot is template, never one that two pages share; all else
is content. Then slots in menus, notices and the like go, which vary as well, and where
there is content in an article only that stays.

Pages with the same texts count once, so a page that was captured again does. Near copies
of an article, with another date, make its text look like a template: a page that would
lose over three quarters of its characters keeps them all. Nothing depends on the order
or the dealing of rows.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections import Counter
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, dealt

#: Bytes of all wrappers up to which they are broadcast; beyond, pages are joined to them by host, hot hosts in shares.
BROADCAST_BYTES = 16_000_000
#: Pages that must hold a text, at least, before it can be template; share of a page's characters that can be.
MIN_PAGES, MOST_TEMPLATE = 3, 0.75
#: Shapes that are aligned in turn; more go up a tree. Keys beyond which a wrapper leaves out those that too few pages have to hold a template, and no others.
FAN, MAX_KEYS = 32, 8_192
#: Longest group, in tokens, that is folded as a repeat.
GROUP = 8
#: Product of two streams' lengths up to which they are aligned in full; longer ones are cut at runs of keys that either has once, long runs first, and stretches without any are matched key by key, looking AHEAD.
ALIGN, ANCHORS, AHEAD = 250_000, (6, 3, 1), 64

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s]+))?""")
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
_OUT = set("nav footer aside form dialog menu button select fieldset head object audio video canvas".split())
_OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Parts that a name of these may have besides; one with any other part, such as share-price, is left alone in an article.
_OUT_PARTS = set("area bar block bottom box btn button buttons container content count footer form group header icon icons inline inner item items left link links list main message middle module outer panel post posts row section slot small text title top unit widget wrap wrapper".split()) | {""}
#: Names that say how a page is laid out, not what an element is.
_LAYOUT = re.compile(r"(?:with|without|no|has)[_\-]")
_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar status toolbar".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an element without an end tag ends, if not just its own kind.
_ENDS = {x: pair for pair in (("dt", "dd"), ("td", "th")) for x in pair}
_OWN_END = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


def _region(tag: str, attrs: str, now: str) -> str:
    """x: what is left out, w: left out but for articles in it, a: the article, b: an article in w, o: none of these."""
    outside = now in ("o", "w")
    if now == "x" or (tag in _OUT and not (tag == "form" and outside)) or (tag == "header" and outside):
        return "x"
    weak, article = now == "w" or tag == "form", tag in ("article", "main")
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                parted = [set(re.split(r"[_\-]+", n)) for n in value.split() if not _LAYOUT.match(n)]
                if not outside:
                    parted = [n for n in parted if all(x in _OUT_NAMES or x in _OUT_PARTS or x.isdigit() for x in n)]
                names = set().union(*parted)
                if tag != "main" and (names & _OUT_NAMES or (outside and tag != "article" and "header" in names)):
                    if not outside or tag == "article":
                        return "x"
                    weak = True
            elif name == "role":
                if value in _OUT_ROLES:
                    return "x"
                article |= value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return "x"
    if article:
        return "b" if weak or now == "b" else "a"
    return "w" if weak else now


def tokens(html: str | None) -> list[tuple[str, str]]:
    """(key, text): '<p>' and '</p>' with no text, '#' + region (x, a or o) with raw text; inline tags are no tokens.

    An article in a container whose name or form would leave it out is the article where the page has no other.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    live: Counter = Counter()  # names on the stack: what isn't there is not looked for

    def close(i: int) -> None:
        for name, _ in stack[i:]:
            live[name] -= 1
        del stack[i:]

    now, at, html = "o", 0, html or ""
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                out.append(("#" + now, text))
            elif text[1:2].isalpha() or text[1:2] == "/":
                pass  # a tag that doesn't end or has an odd quote
            continue
        tag, end = tag.lower(), m[1]
        if end:
            for i in range(len(stack) - 1, -1, -1) if live[tag] > 0 else ():
                if stack[i][0] == tag:
                    close(i)
                    break
            now = stack[-1][1] if stack else "o"
        else:
            if tag in _RAW:
                ended = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = ended.end() if ended else len(html)
                out.append(("|", ""))
                continue
            if tag in _CLOSES_P or tag in _OWN_END:
                own = "p" if tag in _CLOSES_P else tag
                ends = _ENDS.get(own, (own,))
                for i in range(len(stack) - 1, -1, -1) if any(live[x] > 0 for x in ends) else ():
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] not in _INLINE and (own == "p" or stack[i][0] in _OWN_END[own]):
                        break
                now = stack[-1][1] if stack else "o"
            if tag not in _VOID:
                now = _region(tag, m[3], now)
                stack.append((tag, now))
                live[tag] += 1
        if tag not in _INLINE:
            out.append((f"<{end}{tag}>", ""))
    inner = "#x" if any(key == "#a" and not text.isspace() for key, text in out) else "#a"
    return [({"#w": "#x", "#b": inner}.get(key, key), text) for key, text in out]


def slots(toks: list[tuple[str, str]]) -> tuple[list[str], list[bool], list[int], list[int]]:
    """Keys with repeats folded; which of them repeat; for each token its key (-1: none); for each key a hash of its text."""
    keys: list[str] = []
    rep: list[bool] = []
    own: list[int] = [-1] * len(toks)
    text: list[int] = []
    live: list[int] = []  # for each key its node; a folded key's node points to the one that it went into
    up: list[int] = []
    for t, (key, raw) in enumerate(toks):
        if key == "|" or (key[0] == "#" and (key == "#x" and keys and keys[-1] == "#x" or raw.isspace())):
            own[t] = live[-1] if key == "#x" and keys else -1
            continue
        keys.append(key)
        rep.append(False)
        text.append(zlib.crc32(raw.strip().encode("utf-8", "surrogatepass")) if raw else 0)
        own[t] = len(up)
        live.append(own[t])
        up.append(own[t])
        for p in range(1, min(GROUP, len(keys) // 2) + 1):
            if keys[-1] == keys[-1 - p] and keys[-p:] == keys[-2 * p : -p]:
                n = len(keys)
                for j in range(n - p, n):
                    up[live[j]] = live[j - p]
                    rep[j - p] = True
                    text[j - p] = zlib.crc32(b"%d %d" % (text[j - p], text[j]))
                del keys[-p:], rep[-p:], text[-p:], live[-p:]
                break
    place = {node: k for k, node in enumerate(live)}
    for node in range(len(up)):  # a node points to an earlier one
        up[node] = up[up[node]]
    return keys, rep, [place[up[node]] if node >= 0 else -1 for node in own], text


#: A wrapper: a list of [key, repeats, optional, text hash or -1 where it varies, pages that have it].
Wrapper = list[list]


def as_wrapper(keys: list[str], rep: list[bool], text: list[int]) -> Wrapper:
    return [[k, int(r), 0, h if k[0] == "#" else 0, 1] for k, r, h in zip(keys, rep, text, strict=True)]


def _once(keys: list[str], n: int) -> dict[tuple, int]:
    """Runs of n keys that come once, and where."""
    at: dict[tuple, int] = {}
    for i, run in enumerate(zip(*(keys[k:] for k in range(n)), strict=False)):
        at[run] = -1 if run in at else i
    return {run: i for run, i in at.items() if i >= 0}


def _chain(a: list[str], b: list[str], n: int) -> list[tuple[int, int]]:
    """The longest rise of runs of n keys that both have once."""
    of_b = _once(b, n)
    pairs = [(i, of_b[run]) for run, i in _once(a, n).items() if run in of_b]  # in the order of a
    tails: list[int] = []  # last place in b of the best rise of each length
    ends, back = [], [-1] * len(pairs)
    for x, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back[x] = ends[k - 1] if k else -1
        tails[k:] = [j, *tails[k + 1 :]] if k < len(tails) else [j]
        ends[k:] = [x, *ends[k + 1 :]] if k < len(ends) else [x]
    chain, x = [], ends[-1] if ends else -1
    while x >= 0:
        chain.append(pairs[x])
        x = back[x]
    return chain[::-1]


def _ahead(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Equal keys in order, each with the next of b that is not far ahead: linear in both."""
    out, at = [], 0
    for i, key in enumerate(a):
        for j in range(at, min(at + AHEAD, len(b))):
            if b[j] == key:
                out.append((i, j, 1))
                at = j + 1
                break
    return out


def _blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(i, j, n): where a and b agree, in order. Time is bounded by ALIGN for each stretch, and linear in those without an anchor."""
    if len(a) * len(b) <= ALIGN:
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    size, chain = next(((n, c) for n in ANCHORS if (c := _chain(a, b, n))), (0, []))
    if not chain:
        return _ahead(a, b)
    out, i0, j0 = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        if i < i0 or j < j0:  # inside the run before
            continue
        out += [(i0 + p, j0 + q, n) for p, q, n in _blocks(a[i0:i], b[j0:j])]
        n = min(size, len(a) - i)
        if n:
            out.append((i, j, n))
        i0, j0 = i + n, j + n
    return out


def align(a: Wrapper, b: Wrapper, lacks: tuple[int, int] = (0, 0)) -> Wrapper:
    """The wrapper of all streams that either takes: what one lacks is optional, texts that differ are variable.

    lacks: for a and b, pages that a key can have at most which was left out there.
    """
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    out: Wrapper = []
    i0 = j0 = 0
    for i, j, n in [*([(0, 0, len(ka))] if ka == kb else _blocks(ka, kb)), (len(ka), len(kb), 0)]:
        out += [[x[0], x[1], 1, x[3], x[4] + n_pages] for own, n_pages in ((a[i0:i], lacks[1]), (b[j0:j], lacks[0])) for x in own]
        out += [[x[0], x[1] | y[1], x[2] | y[2], x[3] if x[3] == y[3] else -1, x[4] + y[4]] for x, y in zip(a[i : i + n], b[j : j + n], strict=True)]
        i0, j0 = i + n, j + n
    return out


def text_hash(text: str) -> int:
    """Of a slot's text, its white space as single spaces; signed, as Spark has longs."""
    h = xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(4096)
def places(shape: str, wrapper: str) -> list[int]:
    """For each key of a shape its place in the wrapper, or -1."""
    keys = [k.removesuffix("*") for k in shape.split(" ")]
    out = [-1] * len(keys)
    for i, j, n in _blocks([x[0] for x in _loaded(wrapper)], keys):
        out[j : j + n] = range(i, i + n)
    return out


@functools.lru_cache(256)
def _loaded(wrapper: str) -> Wrapper:
    return json.loads(wrapper)


@functools.lru_cache(256)
def _template(template: str) -> frozenset[tuple[int, int]]:
    return frozenset(map(tuple, json.loads(template)))


def shape_of(keys: list[str], rep: list[bool]) -> str:
    return " ".join(k + "*" * r for k, r in zip(keys, rep, strict=True))


def main_text(html: str | None, wrapper: str | None, template: str | None = None) -> str:
    """The page's article: decoded, white space as single spaces, blocks joined by one.

    template: slots and hashes of the texts that are not content, as JSON. Where more
    than MOST_TEMPLATE of the page's characters would be template, all of them stay.
    """
    toks = tokens(html)
    said = [bool(key[0] == "#" and not text.isspace()) for key, text in toks]
    region = "#a" if any(s and key == "#a" for s, (key, _) in zip(said, toks, strict=True)) else "#o"
    out = [key == region for key, _ in toks]
    if wrapper and template:
        keys, rep, own, _ = slots(toks)
        at, gone = places(shape_of(keys, rep), wrapper) if keys else [], _template(template)
        left = [o and not (s and k >= 0 and (at[k], text_hash(text)) in gone) for o, s, k, (_, text) in zip(out, said, own, toks, strict=True)]
        size = lambda kept: sum(len(text) for o, s, (_, text) in zip(kept, said, toks, strict=True) if o and s)
        if size(left) >= (1 - MOST_TEMPLATE) * size(out):
            out = left
    return " ".join("".join(unescape(text) if o else " " for o, (_, text) in zip(out, toks, strict=True)).split())


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _streams(batches):
    """Pages -> (host, page, shape, keys, texts): a hash of what the page says, its stream without texts, and for each text its key and hash."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for h, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            toks = tokens(html)
            keys, rep, own, _ = slots(toks)
            held = [(k, text) for k, (key, text) in zip(own, toks, strict=True) if k >= 0 and key in ("#a", "#o") and not text.isspace()]
            found = sorted({(k, text_hash(text)) for k, text in held})
            page = text_hash(" ".join(str(t) for _, t in found))
            for column, value in zip(out, (h, page, shape_of(keys, rep), [k for k, _ in found], [t for _, t in found]), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["host", "page", "shape", "keys", "texts"])


def _merge(batches):
    """Wrappers, or shapes, sorted by host and bucket -> one a bucket, aligned in turn; holds one at a time.

    held: pages in it; lacks: pages that a key can have at most which was left out.
    pages: the host's distinct ones, of which a template is in half; total: those of all
    its shapes. Of a bucket with more than MAX_KEYS keys those go that have less than
    pages / 2 * held / total: what has so few in each bucket has less than half of all.
    Until the last bucket a key counts with all pages that may have been left out, and
    in the end each page is placed and counted anew, so no template loses its slot.
    """
    last, w, held, lacks = None, [], 0, 0
    done: list[tuple] = []

    def flush():
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], ["host", "bucket", "buckets", "pages", "total", "wrapper", "held", "lacks"])

    def end():
        pages, total = last[3:]
        few = [2 * x[4] * total < pages * held for x in w] if len(w) > MAX_KEYS else [False] * len(w)
        least = max([lacks, *(x[4] for x, f in zip(w, few, strict=True) if f)])
        done.append((*last, json.dumps([x for x, f in zip(w, few, strict=True) if not f], separators=(",", ":")), held, least))

    for b in batches:
        for *at, text, n, size, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if n:  # a shape of n pages
                parts = text.split(" ")
                keys = [k.removesuffix("*") for k in parts]
                new = [[*x[:4], n] for x in as_wrapper(keys, [k.endswith("*") for k in parts], [0] * len(keys))]
            else:
                new = json.loads(text)
            if tuple(at) == last:
                w, held, lacks = align(w, new, (lacks, left)), held + size, lacks + left
                continue
            if last is not None:
                end()
            last, w, held, lacks = tuple(at), new, size, left
            if len(done) >= 1_000:
                yield flush()
                done = []
    if last is not None:
        end()
        yield flush()


def wrappers(streams: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, wrapper): one for each host, as JSON, over the shapes of all its pages. pages: (host, pages), their distinct ones.

    Shapes are dealt to buckets by their hash, FAN a bucket or so, and aligned in order
    of pages and text; then buckets are, FAN at a time, until a host has one.
    """
    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = cut(streams.where("shape <> ''").select("host", "shape", "page").distinct().groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes")
    counts = cut(shapes.groupBy("host").agg(F.count("*").alias("n"), F.sum("n").alias("total")).join(pages, "host"), "shape-counts")
    left, right, on = dealt(shapes, counts.withColumnRenamed("n", "shapes"), counts.select("host", "n"), ["host"], ["shape"])
    buckets = F.ceil(F.col("shapes") / FAN)
    rows = left.join(right, on).select("host", F.pmod(F.xxhash64("shape"), buckets).alias("bucket"), buckets.alias("buckets"), "pages", "total", F.col("shape").alias("wrapper"), "n", F.col("n").alias("held"), F.lit(0).cast("long").alias("lacks"), (-F.col("n")).alias("order"))
    most = -(-(counts.agg(F.max("n")).first()[0] or 1) // FAN)
    while True:
        rows = rows.repartition(parts, "host", "bucket").sortWithinPartitions("host", "bucket", "buckets", "order", "wrapper").select("host", "bucket", "buckets", "pages", "total", "wrapper", "n", "held", "lacks").mapInArrow(_merge, "host string, bucket long, buckets long, pages long, total long, wrapper string, held long, lacks long")
        if most <= 1:
            return rows.select("host", "wrapper")
        most = -(-most // FAN)
        up = F.ceil(F.col("buckets") / FAN)
        rows = cut(rows, "wrapper-level").select("host", F.pmod("bucket", up).alias("bucket"), up.alias("buckets"), "pages", "total", "wrapper", F.lit(0).cast("long").alias("n"), "held", "lacks", F.col("bucket").alias("order"))


def _placed(batches):
    """Streams with their host's wrapper -> (host, page, slot, text): each text of a page at its place in the wrapper."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for h, page, shape, keys, texts, wrapper in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = places(shape, wrapper)
            for slot, text in {(at[k], t) for k, t in zip(keys, texts, strict=True) if at[k] >= 0}:
                for column, value in zip(out, (h, page, slot, text), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["host", "page", "slot", "text"])


def _with(rows: DataFrame, known: DataFrame, counts: DataFrame, salt: list[str], how: str) -> DataFrame:
    """rows joined by host to what is known of hosts: broadcast where that is small, else dealt."""
    size = known.agg(F.sum(sum(F.length(c) for c in known.columns))).first()[0] or 0
    left, right, on = (rows, F.broadcast(known), ["host"]) if size <= BROADCAST_BYTES else dealt(rows, known, counts, ["host"], salt)
    return left.join(right, on, how)


def templates(streams: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, wrapper, template) of the hosts that have one. counts: (host, n, pages), rows and distinct pages."""
    large = counts.where(F.col("pages") >= MIN_PAGES)
    some = _with(streams, large.select("host"), counts.select("host", "n"), ["shape", "page"], "inner").select(streams.columns)
    some = cut(some, "streams-of-hosts")
    known = cut(wrappers(some, large.select("host", "pages")), "wrappers")
    placed = _with(some, known, counts.select("host", "n"), ["shape", "page"], "inner").select("host", "page", "shape", "keys", "texts", "wrapper").mapInArrow(_placed, "host string, page long, slot int, text long")
    # half of a host's pages hold these, so a host has not many
    held = placed.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("held")).where(F.col("held") >= MIN_PAGES)
    held = cut(held, "slot-texts").join(large.select("host", "pages"), "host").where("2 * held >= pages")
    found = held.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.array(F.col("slot").cast("long"), "text")))).alias("template"))
    return found.join(known, "host").select("host", "wrapper", "template")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    Null and empty pages, and pages with nothing outside what is left out, have an
    empty text. A url without a host is of the host ''. Repeated rows each give a row,
    and count once in their host's template.
    """
    own = host(F.col("url")).alias("host")
    streams = cut(pages.select(own, "html").mapInArrow(_streams, "host string, page long, shape string, keys array<int>, texts array<long>"), "streams")
    counts = cut(streams.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages")), "page-counts")
    known = cut(templates(streams, counts), "templates")

    def texts(html: pa.Array, wrapper: pa.Array, template: pa.Array) -> pa.Array:
        return pa.array([main_text(*row) for row in zip(html.to_pylist(), wrapper.to_pylist(), template.to_pylist(), strict=True)], pa.string())

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", own)
    rows = _with(rows, known, counts.select("host", "n"), ["page_id", "url"], "left")
    rows = rows.select("page_id", "url", F.arrow_udf(texts, StringType()).asNondeterministic()("html", "wrapper", "template").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
