"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule's cost and what it rejects are estimated on a sample; rules then run by
rejection per cost, and a document that one rejects is not given to the later, dearer
ones. The order changes what is spent, never what is kept.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SYMBOLS = "#*$%&|<>"
#: Rows, about, that costs and rejections are estimated on; they set the order of rules and nothing else.
SAMPLE_ROWS = 1_000
#: Bits of a window's number that hold its place; the rest are of its hash.
PLACE_BITS = 20

_WHITE = r"[\\x20\\x09-\\x0D]+"
_WORD = r"[^\\x20\\x09-\\x0D]"


def repeat_words(place_bits: int = PLACE_BITS) -> str:
    """SQL: of the words of the array w, how many lie in a 3-word window found twice or more, the first included.

    Windows are sorted as numbers, hash above place, so those of one hash stand side by
    side. If all neighbours of one hash have the same words, as they do unless hashes
    collide, these are the windows found again. Else, or in a text of more than
    2^place_bits words, windows are sorted by hash and words, which is slower and exact
    for any text. Places, sorted again, add three words each, less what the one before
    covers. O(n log n). Arrays of one element bind a value to a name, so that it is made once.
    """
    m = (1 << place_bits) - 1
    same = " AND ".join(f"w[cast(e.a & {m}L AS int) + {k}] = w[cast(e.b & {m}L AS int) + {k}]" for k in range(3))
    places = "sequence(0, size(w) - 3)"
    numbers = f"sort_array(transform({places}, i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~{m}L) | i))"
    twins = f"transform(array({numbers}), s -> array_compact(zip_with(s, slice(s, 2, size(s)), (a, b) -> IF((a | {m}L) = (b | {m}L), named_struct('a', a, 'b', b), NULL))))[0]"
    fast = f"flatten(transform(p, e -> array(e.a & {m}L, e.b & {m}L)))"
    structs = f"sort_array(transform({places}, i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'x', w[i], 'y', w[i + 1], 'z', w[i + 2], 'i', cast(i AS long))))"
    exact = f"transform(array({structs}), s -> flatten(array_compact(zip_with(s, slice(s, 2, size(s)), (a, b) -> IF(a.h = b.h AND a.x = b.x AND a.y = b.y AND a.z = b.z, array(a.i, b.i), NULL)))))[0]"
    found = f"IF(size(w) <= {m}, transform(array({twins}), p -> IF(exists(p, e -> NOT ({same})), {exact}, {fast}))[0], {exact})"
    return f"IF(size(w) < 4, 0L, aggregate(array_sort(array_distinct({found})), named_struct('last', -3L, 'sum', 0L), (a, v) -> named_struct('last', v, 'sum', a.sum + least(3L, v - a.last)), a -> a.sum))"


def _of(text: str) -> str:
    """SQL: the column of that name, null as empty."""
    return f"coalesce(`{text.replace('`', '``')}`, '')"


def _words(t: str) -> str:
    return f"transform(array(regexp_replace({t}, '^{_WHITE}|{_WHITE}$', '')), b -> IF(b = '', cast(array() AS array<string>), split(b, '{_WHITE}')))[0]"


#: What a text is parted into, as SQL over a text t that is not null.
PARTS = {"w": _words("t"), "l": rf"filter(split(t, '\\n'), x -> x rlike '{_WORD}')"}
#: What rules look at: the part that it is of, and SQL over it.
MEASURES = {
    "n_words": ("w", "size(w)"),
    "word_chars": ("w", "length(array_join(w, ''))"),
    "n_symbols": (None, f"length(regexp_replace(t, '[^{SYMBOLS}]++', ''))"),
    "n_lines": ("l", "size(l)"),
    "n_dup_lines": ("l", "size(l) - size(array_distinct(l))"),
    "n_repeat_words": ("w", repeat_words()),
}


@dataclass(frozen=True)
class Rule:
    """name, and when a document fails, in terms of MEASURES."""

    name: str
    fails: str

    @property
    def needs(self) -> list[str]:
        return [k for k in MEASURES if re.search(rf"\b{k}\b", self.fails)]

    @property
    def parts(self) -> set[str]:
        return {MEASURES[k][0] for k in self.needs} - {None}


def _passes(rules: list[Rule], bound: dict[str, str]) -> str:
    """SQL over t: whether no rule rejects it, the first that does ends it. What a rule needs is made when it is reached, once for it and those after it. bound: names of what is made already."""
    if not rules:
        return "true"
    rule, at = rules[0], f"m{len(bound)}"
    new = [k for k in rule.needs if k not in bound]
    names = bound | {k: f"{at}.{k}" for k in new}
    fails = re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], rule.fails) if names else rule.fails
    out = f"IF({fails}, false, {_passes(rules[1:], names | {p: p for p in rule.parts})})"
    if new:
        out = f"transform(array(struct({', '.join(f'{MEASURES[k][1]} AS {k}' for k in new)})), {at} -> {out})[0]"
    for p in sorted(rule.parts - set(bound)):
        out = f"transform(array({PARTS[p]}), {p} -> {out})[0]"
    return out


#: A document is rejected if any rule says so; the first two are the base rules.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repetition", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
)
BASE = RULES[:2]


def measured(text: str = "text") -> Column:
    """A struct of all MEASURES, as longs, of the column of that name (null: empty). Words and lines are parted once."""
    out = "struct(" + ", ".join(f"cast({v} AS long) AS {k}" for k, (_, v) in MEASURES.items()) + ")"
    for p, v in PARTS.items():
        out = f"transform(array({v}), {p} -> {out})[0]"
    return F.expr(f"transform(array({_of(text)}), t -> {out})[0]")


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules in the order that rejects most per cost, on a random sample of about SAMPLE_ROWS rows of the whole table.

    Rejections are counted for all rules together, so a rule counts for what those
    before it leave. Cost is the time of the rule on the sample, less that of a pass
    that does nothing, both once code is compiled, and less that of parting the text
    where a rule before it has done so.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = docs.select(F.expr(_of(text)).alias("t")).sample(min(1.0, 2 * SAMPLE_ROWS / n), seed=42).limit(SAMPLE_ROWS)
    sample = cut(sample, "quality-sample")

    def seconds(cond: str) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.where(cond).count()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds("length(t) < 0")
    part_cost = {p: max(seconds(f"size({v}) < 0") - idle, 0.0) for p, v in PARTS.items()}
    cost = [seconds(f"NOT {_passes([r], {})}") - idle for r in rules]
    flags = [F.expr(f"NOT {_passes([r], {})}").alias(f"r{i}") for i, r in enumerate(rules)]
    seen = [tuple(x) for x in sample.select(*flags).groupBy(*(f"r{i}" for i in range(len(rules)))).count().collect()]  # 2^rules rows at most
    order: list[int] = []
    while len(order) < len(rules):
        left = [x for x in seen if not any(x[i] for i in order)]
        made = {p for i in order for p in rules[i].parts}
        worth = lambda i: (sum(x[-1] for x in left if x[i]) + 0.5) / max(cost[i] - sum(part_cost[p] for p in made & rules[i].parts), 1e-3)  # noqa: B023, E731
        order.append(max((i for i in range(len(rules)) if i not in order), key=worth))
    return [rules[i] for i in order]


def cascade(rules: list[Rule], text: str | None = None) -> Column:
    """True where no rule rejects: the first that does ends it. With text, the name of a column, each rule makes what it needs; without, columns of measures are read."""
    if text is not None:
        return F.expr(f"transform(array({_of(text)}), t -> {_passes(rules, {})})[0]")
    out = F
    for rule in rules:
        out = out.when(F.expr(rule.fails), False)
    return F.lit(True) if out is F else out.otherwise(True)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that every rule passes; rules run in the order that a sample recommends.

    Null and empty texts have no word and fail. Repeated rows are judged alike.
    """
    return docs.where(cascade(order_rules(docs, text), text))


def quality(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, text): the base measures, base_failed, and kept: what the cascade says.

    All measures are over whole texts and are returned for every row, so each is made
    once. The cascade then runs the other rules for what base_failed leaves, over these
    columns and in the order that a sample recommends, which changes no verdict. Null
    and empty texts have no word and fail. Repeated rows and ids each give a row. No shuffle.
    """
    order = [r for r in order_rules(docs) if r not in BASE]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured().alias("m")).select("doc_id", "m.*")
    failed = F.expr(" OR ".join(f"({r.fails})" for r in BASE))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(cascade(order)).alias("kept"))
