"""Filter audit, conversation trie and URL filters against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lakeseek.llm import audit, common, trie, urlfilter
from lakeseek.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, n long, h string, bits string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """Straight from the definition: every order, every step, every document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        w = WORDS.findall(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
    removed = Counter()
    for (part, order, step), v in out.items():
        removed[part, order[step - 1]] += v[1]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_docs():
    rng, rows = random.Random(11), []
    texts = [" ".join(rng.choice(["Aa", "bb", "CCC", "d", "e#", f"w{rng.randrange(90)}"][: rng.randrange(2, 7)] + [f"x{k}" for k in range(rng.choice([0, 200]))]) for _ in range(rng.choice([3, 99, 100, 101, 150]))) for _ in range(60)]
    for i in range(150):
        rows.append((i, rng.choice(texts), rng.choice(["en", "de", None, ""])))
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (3, texts[1], "en"), (3, texts[1], "en"), (4, None, "fr"), (5, "", "fr"), (5, None, None), (-7, "A B C", "x"), (900, " ".join(f"w{i}" for i in range(30_000)), "long")]
    return rows


def test_audit_equals_every_order_by_hand(spark):
    docs, labels = audit_docs(), [(i, i % 2, i % 3) for i in range(0, 200, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (5, None, None)]
    d = spark.createDataFrame([(i, t, p, 1, "h", "b") for i, t, p in docs], DOCS)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(docs, labels) and len(got) == 600 * len({p or "" for *_, p in docs})


@pytest.mark.parametrize("few", [True, False])
def test_audit_of_one_hot_text(spark, monkeypatch, few):
    """A third of all rows has one text: dealt out in shares, with hashes broadcast or not."""
    monkeypatch.setattr(common, "PER_TASK", 10)
    monkeypatch.setattr(audit, "BROADCAST_HASHES", 1_000 if few else -1)
    docs = [(i, "one text" if i % 3 else f"text {i % 30}", "en") for i in range(300)]
    d = spark.createDataFrame([(i, t, p, 1, "h", "b") for i, t, p in docs], DOCS)
    got = audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(docs, [])


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


CHATS = "conv_id long, turn long, role string, text string, pos long, x string"


def trie_of(rows):
    """Rebuilt texts in full, and a dictionary of their prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(rebuilt[c]) == len(k)).encode()).hexdigest()
    return Counter((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], sha(k)) for k, v in members.items())


def chats(seed=3, n=150):
    rng, rows = random.Random(seed), []
    for c in [*range(0, n), *rng.sample(range(200, 900), 60), -1, -100, -130]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "b", "", None, "é🙂"])) for t in range(rng.randrange(1, 9))]
    rows += [(7, None, "user", "late"), (7, None, "user", "early"), (8, 2, "user", "tie"), (8, 2, "assistant", "tie"), (9, 1, "user", "x"), (9, 1, "user", "x"), (None, 1, "user", "of none")]
    return rows


def tree(spark, rows):
    return Counter(tuple(r) for r in trie.conversation_trie(spark.createDataFrame([(*r, 5, "x") for r in rows], CHATS)).collect())


def test_trie_equals_rebuilt_texts(spark):
    rows = chats()
    rows = [r for r in rows if r[0] != 100]  # a base that is absent
    want = trie_of(rows)
    assert max(k[1] for k in want) > 6 and tree(spark, rows) == want


def test_trie_of_hot_conversations(spark, monkeypatch):
    """One conversation many times, one first turn with many ways on, one that is long: blocks of ids and shares."""
    monkeypatch.setattr(common, "PER_TASK", 5)
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "BROADCAST_KEYS", -1)
    rows = [(c, t, "user", "same") for c in range(0, 60) for t in range(7)] + [(c, t, "user", "first" if t == 0 else f"way {c} {t}") for c in range(300, 360) for t in range(7)] + [(777, t, "user", str(t % 7)) for t in range(1_000)]
    assert tree(spark, rows) == trie_of(rows)


def test_trie_tries_again_where_fingerprints_meet(spark, monkeypatch):
    """A base of 1 sums without order, so prefixes of the same turns in another order meet; that is seen and mended."""
    monkeypatch.setattr(trie, "BASES", ((1, 1, 1), *trie.BASES[1:]))
    rows = [(c, t, "user", str((t * (c + 1)) % 7)) for c in range(40) for t in range(7)]
    assert tree(spark, rows) == trie_of(rows)
    monkeypatch.setattr(trie, "BASES", ((1, 1, 1),))
    with pytest.raises(RuntimeError):
        tree(spark, rows)


def test_equal_hashes_of_turns_are_compared_as_texts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    turns = trie.numbered(rows, 0)
    assert not trie.turns_differ(rows, turns, 0)
    monkeypatch.setattr(trie.F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all turns are called equal
    assert trie.turns_differ(rows, turns.withColumns({"x": F.lit(1).cast("long"), "y": F.lit(1).cast("long")}), 0)
    monkeypatch.undo()
    got = spark.range(0, 70_000, 977).select("id", trie.power(F.col("id"), 16807, 2147483647).alias("p")).collect()
    assert all(r.p == pow(16807, r.id, 2147483647) for r in got)


def test_trie_of_nothing(spark):
    assert tree(spark, []) == Counter() and tree(spark, [(None, 1, "user", "x")]) == Counter()


PAGES = "page_id long, url string, html string, host string, trust string"


def parts(url):
    _, found, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    return (low, m[2]) if found else ("", "")


def judged(rows, links, rules, rounds=urlfilter.ROUNDS):
    said = []
    for _, url in rows:
        h, p = parts(url)
        fits = [(len(rh) + len(rp), len(rh), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        said.append((h, p, *(max(fits)[2:] if fits else (None, None))))
    n = Counter((h, v) for h, _, _, v in said)
    edges = {(a, b) for a, b in links if a and b and a != b}
    scores = []
    for kind, v in enumerate(("allow", "block")):
        seed = {h: n[h, v] * urlfilter.SCALE // (n[h, "allow"] + n[h, "block"]) for h, x in n if h and x}
        way = [(b, a) if kind else (a, b) for a, b in edges]
        deg = Counter(a for a, _ in way)
        start = {h: s * (100 - urlfilter.DAMPING) // 100 for h, s in seed.items()}
        now = dict(start)
        for _ in range(rounds if edges else 0):
            got = Counter()
            for a, b in way:
                got[b] += now.get(a, 0) // deg[a]
            now = Counter(start)
            for h, x in got.items():
                now[h] += x * urlfilter.DAMPING // 100
        scores.append(now)
    t, d = scores
    return Counter((i, h, p, r, v or ("block" if d.get(h, 0) > t.get(h, 0) else "allow"), None if r else t.get(h, 0), None if r else d.get(h, 0)) for (i, _), (h, p, r, v) in zip(rows, said, strict=True))


def crawl(seed=5, n=400):
    """Pages of hosts of several domains, with absolute links among them."""
    rng = random.Random(seed)
    hosts = [f"{a}{b}" for a in ("a.", "B.", "c.a.", "") for b in ("example.org", "example.com", "x.net", "y.net", "example.net")] + [f"h{i}.net" for i in range(20)]
    rows, links = [], set()
    for i in range(n):
        h = rng.choice(hosts) if i % 3 else "hub.net"
        to = [rng.choice(hosts) for _ in range(rng.randrange(4))]
        html = "<p>x" + "".join(rng.choice([f"<a href='https://{t}/x'>l</a>", f'<A class="b" HREF = "//{t}">l', f"<a\nhref={t and 'http://' + t}?q=1>", ]) for t in to) + "<a href='/own'>o</a><a data-href='http://no.where/'>n</a>"
        rows.append((i, f"http{'s' * (i % 2)}://{h}{rng.choice(['/fr/', '/de/', '/es/1', '/en/12', '/en/2', '', '/'])}{rng.choice(['', '?a=/fr/', '#x'])}", html))
        links |= {(h.lower(), t.lower()) for t in to}
    return rows, links


@pytest.mark.parametrize("hot", [False, True])
def test_url_verdicts_equal_walks_by_hand(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "PER_TASK", 3)
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", -1)
    rows, links = crawl()
    rows += [(None, None, None), (1000, "no scheme", "<a href='http://a.example.com/'>"), (1001, "x://", None), (1002, "HTTPS://EXAMPLE.Org/EN/1", ""), (1003, "a://b://example.org/es/", None), (5, "http://É.ORG/p\nq", "<a href=http://"), (5, "http://É.ORG/p\nq", "<a href=http://"), (6, "https://notexample.org/es/", None), (7, "http://example.com?x", None)]
    d = spark.createDataFrame([(i, u, h, "mine", "t") for i, u, h in rows], PAGES)
    got = Counter(tuple(r) for r in urlfilter.judge(d, RULES).collect())
    want = judged([r[:2] for r in rows], links, RULES)
    assert got == want
    by_method = Counter(k[4] for k in want if k[3] is None)
    assert by_method["block"] > 10 and by_method["allow"] > 10


def test_url_rules_ties_and_nothing(spark):
    d = spark.createDataFrame([(1, "http://a.bc/de", None, "", "")], PAGES)
    assert urlfilter.judge(d, [("block", "bc", "/de"), ("allow", "a.bc", "/"), ("block", "a.bc", "/x")]).first()[3:5] == ("a.bc/", "allow")  # as long, the longer host
    assert urlfilter.judge(d, []).first()[3:5] == (None, "allow")
    assert urlfilter.judge(d.where("false"), RULES).count() == 0
