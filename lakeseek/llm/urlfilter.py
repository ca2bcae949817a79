"""URL filters: rules of hosts and paths, and trust that flows over links where no rule says.

A rule names a host, with all below it, and the start of a path. Hosts whose urls rules
allow are seeds of trust, hosts whose urls rules block seeds of distrust. Trust follows
the links between hosts (personalised PageRank from the allowed); distrust goes against
them, to the hosts that link to blocked ones. Urls without a rule are judged by their
host: blocked where distrust is more than trust.

Scores are whole numbers of 1 / SCALE, divided and rounded down, so they don't depend
on the order of sums or the dealing of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt

#: A seed's score; what a walk goes on with at each link, in percent; steps of the walk; those between two cuts of the lineage.
SCALE, DAMPING, ROUNDS, EVERY = 1_000_000_000, 85, 20, 5
#: Blocked hosts are broadcast up to this number of bytes; beyond, pages are joined to them, hot hosts in shares.
BROADCAST_BYTES = 8_000_000
#: An absolute link in an anchor tag, with or without its scheme.
LINK = r"""(?i)<a_(?:[^<>]*?_)?href_*=_*["']?_*((?:[a-z][a-z0-9+.\-]*:)?//[^"'<>\x09-\x0D\x20]+)""".replace("_", r"[\x09-\x0D\x20]")
_ABC = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """What is after the first :// up to /, ? or # or the end, A-Z in lower case; '' without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_ABC)


def path(url: Column) -> Column:
    """What is after the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) or nulls: of the rules that fit, the one with most characters, of these the one with the longest host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): each pair of hosts with a link from one to the other, once. Relative links and links to the same host are none."""
    links = pages.where("html is not null").select(host(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(F.regexp_extract(x, "//([^/?#]*)", 1), *_ABC)))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """Edges (src, dst) and seeds (host, trust, distrust) -> (host, trust, distrust) of all hosts that have either.

    Both walks in one: a state row is (host, kind, score), kind 0 trust, which a host
    gives in equal shares to those that it links to, kind 1 distrust, in equal shares
    to those that link to it. A walk ends at a host without links. Each round is one
    join and one aggregation; contributions are summed before they are shuffled.
    """
    ways = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(0).alias("kind")).union(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(1).alias("kind")))
    degrees = cut(ways.groupBy("host", "kind").agg(F.count("*").alias("n")), "url-degrees")
    # a hub's links are dealt out once, in shares that each get its score
    ways, degrees, on = dealt(ways, degrees, degrees, ["host", "kind"], ["to"])
    ways, degrees = cut(ways, "url-ways"), cut(degrees, "url-shares")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("seed")))).alias("x"))
    start = cut(start.select("host", "x.kind", "x.seed").where("seed > 0"), "url-seeds")
    kept = start.select("host", "kind", F.expr(f"seed * {100 - damping} div 100").alias("score"))
    state = kept
    for r in range(0 if degrees.isEmpty() else rounds):
        given = state.join(degrees, ["host", "kind"]).select(*on, F.expr("score div n").alias("part")).where("part > 0")
        moved = ways.join(given, on).groupBy(F.col("to").alias("host"), "kind").agg(F.sum("part").alias("part"))
        state = kept.union(moved.select("host", "kind", F.expr(f"part * {damping} div 100"))).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if r % EVERY == EVERY - 1:
            state = cut(state, "url-state")
    return state.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).cast("long").alias(name) for k, name in ((0, "trust"), (1, "distrust"))])


def judge(pages: DataFrame, rules: Sequence[Rule], rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): a row for each row of pages.

    A host's seed of trust is SCALE times the share of its urls with a rule that are
    allowed, its seed of distrust that of the blocked. Urls of hosts that nothing
    reaches, and those without a host, are allowed. Null urls and urls without ://
    have an empty host and path; null html has no links. trust and distrust are those
    of the host for urls without a rule, else null. Repeated rows each give a row.
    """
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    at = at.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    counts = cut(at.groupBy("host").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")], F.count("*").alias("n")), "url-hosts")
    seeds = counts.where("allow + block > 0 and host <> ''").select("host", F.expr(f"cast(allow as decimal(20, 0)) * {SCALE} div (allow + block)").alias("trust"), F.expr(f"cast(block as decimal(20, 0)) * {SCALE} div (allow + block)").alias("distrust"))
    scores = cut(propagate(cut(host_edges(pages), "url-edges"), seeds, rounds, damping).join(counts.where("n > allow + block").select("host"), "host", "left_semi"), "url-scores")
    size = scores.agg(F.sum(F.length("host") + 16)).first()[0] or 0
    left, right, on = (at, F.broadcast(scores), ["host"]) if size <= BROADCAST_BYTES else dealt(at, scores, counts.select("host", "n"), ["host"], ["page_id"])
    at = left.join(right, on, "left")
    by_host = F.when(F.coalesce(F.col("distrust") > F.col("trust"), F.lit(False)), "block").otherwise("allow")
    mine = lambda c: F.when(F.col("rule").isNull(), F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return at.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), mine("trust"), mine("distrust"))
