"""Exact token counts at every prefix, by dynamic programming.

The last token of a prefix decides the count of all prefixes it can be part of: if the
encoding of s[:i] ends in token t, then s[:i - len(t)] is encoded as the rest, since no
merge crosses the border of two tokens, and what merges left of it doesn't depend on
what stands right. So

    count[i] = count[i - len(t)] + 1, with t the one piece that ends at i and stays
    apart from the last token of s[:i - len(t)]

(two pieces stay apart if their texts together are encoded as just these two; that is
asked of the library once for each pair of pieces). A character in no piece is counted
by its bytes. No piece spans the start of a run of spaces, so a text's table is made of
its parts' tables, each added to the count before it; parts that come again are looked
up. Counts, truncation and budgets read the table and encode nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: Bytes, about, of the tables of parts that a worker keeps, and pairs of pieces; beyond them either store starts anew.
KEPT_BYTES, KEPT_PAIRS = 320_000_000, 1_000_000
#: Parts of a text that are looked up in one go, and characters from which a part is not kept.
STRETCH, LONG_PART = 200_000, 200
_counters: dict = {}


class PrefixCounter:
    """Counts of a sentencepiece BPE model that leaves texts as they are (no normalisation but the space put before)."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type != 2 or any(p.type == 4 for p in proto.pieces):
            raise ValueError("the counts hold for BPE models without normalisation and user-defined pieces only")
        spec.add_dummy_prefix = False  # parts are counted as they stand in the text
        self._own = sentencepiece.SentencePieceProcessor()
        self._own.LoadFromSerializedProto(proto.SerializeToString())
        pieces = {p.piece.replace("▁", " "): i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any("\n" in p or " " in p.lstrip(" ") for p in pieces):
            raise ValueError("pieces span white space")
        whole = self._own.encode(list(pieces), num_threads=1)
        #: Pieces by text, those only that are encoded as themselves: others end no prefix.
        self._pieces = {p: i for (p, i), ids in zip(pieces.items(), whole, strict=True) if ids == [i]}
        self._text_of = {i: p for p, i in self._pieces.items()}
        self._chars = {p for p in pieces if len(p) == 1}
        self._tree: dict = {}  # by character: the piece that ends there (-1: none) and what may follow
        for p, i in self._pieces.items():
            node = self._tree
            for c in p[:-1]:
                node = node.setdefault(c, [-1, {}])[1]
            node.setdefault(p[-1], [-1, {}])[0] = i
        self._apart: dict[int, bool] = {}
        self._parts = re.compile(r" +[^ \n]*|\n[^ \n]*")
        self._last: dict[str, int] = {}
        self._tables: dict[str, bytes] = {}
        self._bytes = 0

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= KEPT_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._own.encode(self._text_of[a] + self._text_of[b]) == [a, b]
        return known

    def heads(self, part: str) -> list[int]:
        """Tokens of part[:i] for i from 1; a part starts with all the spaces before it. Linear in its length, and in that of the longest piece.

        Of the pieces that begin where a prefix ends, each that stays apart from its last
        token gives the count of a longer prefix; a prefix gets it from one piece only.
        """
        n, apart = len(part), self._apart.get
        count, last = [0] * (n + 1), [-1] * (n + 1)  # last: the token that ends there, -1 at the start and after what is in no piece
        for i, c in enumerate(part):
            if c not in self._chars:
                count[i + 1] = count[i] + len(c.encode("utf-8", "surrogatepass"))
                continue
            before, more, node = last[i], count[i] + 1, self._tree
            key = before << 32
            for j in range(i, n):
                found = node.get(part[j])
                if found is None:
                    break
                t, node = found
                if t < 0 or count[j + 1]:
                    continue
                known = before < 0 or apart(key | t)
                if known or (known is None and self._stay_apart(before, t)):
                    count[j + 1], last[j + 1] = more, t
            if not count[i + 1]:
                raise ValueError(f"no piece ends after {part[: i + 1]!r}")
        return count[1:]

    def _learn(self, keys) -> None:
        """Tables of new keys. A key is a part less the space it starts with; one that starts with a line end has no space."""
        new = [k for k in dict.fromkeys(keys) if k not in self._last]
        for k in new:
            table = self.heads(k if k[:1] == "\n" else " " + k)
            self._last[k] = table[-1]
            if len(k) < LONG_PART:
                self._tables[k] = bytes(table) if max(table) < 256 else np.array(table, "<u4").tobytes()
            self._bytes += 250 + len(k) * (2 if len(k) < LONG_PART else 1)

    def _keys(self, text: str) -> list[str]:
        if text[0] == " " or "  " in text or " \n" in text:
            return [p[1:] if p[0] == " " else p for p in self._parts.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def _counts(self, keys: list[str]) -> list[int]:
        try:
            return list(map(self._last.__getitem__, keys))
        except KeyError:
            if self._bytes > KEPT_BYTES:
                self._last.clear()
                self._tables.clear()
                self._bytes = 0
            self._learn(keys)
            return list(map(self._last.__getitem__, keys))

    def _table(self, key: str) -> np.ndarray:
        """Counts at the prefixes of a part that was counted; the space that was put before is one of them."""
        n = len(key) + (key[:1] != "\n")
        kept = self._tables.get(key)
        if kept is None:
            return np.array(self.heads(key if key[:1] == "\n" else " " + key))
        return np.frombuffer(kept, np.uint8 if len(kept) == n else "<u4").astype(np.int64)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of its table."""
        return self.fit(text, 0)[0]

    def fit(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and characters of its longest prefix of budget tokens at most. Nothing is encoded for the second."""
        if not text:
            return 0, 0
        text, total, chars, fits = text.replace("▁", " "), 0, 0, -1
        keys = self._keys(text)
        for i in range(0, len(keys), STRETCH):  # a long text goes through in stretches
            some = keys[i : i + STRETCH]
            counts = self._counts(some)
            own = sum(counts)
            if budget and fits < 0 and total + own > budget:
                at = int(np.searchsorted(np.cumsum(counts) + total, budget, "right"))  # the part that goes over; those after it have more at each prefix
                done, before = sum(len(k) + (k[:1] != "\n") for k in some[:at]), total + sum(counts[:at])
                fits = chars + done + int(np.flatnonzero(np.concatenate([[0], self._table(some[at])]) + before <= budget)[-1])
            total += own
            if budget and fits < 0:
                chars += sum(map(len, some)) + sum(k[:1] != "\n" for k in some)
        return total, len(text) if fits < 0 else max(0, fits - 1)  # the space put before is no character of the text

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of text[:i], for each i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        keys = self._keys(text.replace("▁", " "))
        counts, tables = [], []
        for i in range(0, len(keys), STRETCH):
            counts += self._counts(keys[i : i + STRETCH])
            tables += map(self._table, keys[i : i + STRETCH])
        out = np.concatenate(tables) + np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), [len(t) for t in tables])
        out[0] = 0  # an empty prefix has no space put before it
        return out

    def truncate(self, text: str | None, budget: int) -> tuple[str, int]:
        """The longest prefix of budget tokens at most, and its tokens. A longer prefix can have fewer tokens, so the last that fits is taken."""
        counts = self.prefix_counts(text)
        at = int(np.flatnonzero(counts <= budget)[-1])
        return (text or "")[:at], int(counts[at])


def counter(model_file: str | None = None) -> PrefixCounter:
    """This process's counter for a model file (default: MODEL of the public tokenizers)."""
    if model_file not in _counters:
        import public_tokenizers

        _counters[model_file] = PrefixCounter(model_file or public_tokenizers.path(MODEL))
    return _counters[model_file]


def token_counts(docs: DataFrame, limit: int = 4096, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) for each row, over whole texts; null and empty texts have 0 tokens.

    fit_chars: code points of the longest prefix of limit tokens at most. No shuffle.
    """

    def read(texts: pa.Array) -> pa.Array:
        c = counter(model_file)
        n, chars = zip(*(c.fit(t, limit) for t in texts.to_pylist()), strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(chars, pa.int64())], ["n", "chars"])

    of = F.arrow_udf(read, "n long, chars long").asNondeterministic()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), of(F.col("text")).alias("x"))
    return rows.select("doc_id", "n_bytes", F.col("x.n").alias("n_tokens"), (F.col("x.n") > limit).alias("over_limit"), F.col("x.chars").alias("fit_chars"))


def prefix_table(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, counts): tokens at every prefix of each text, in code points from 0 to its length; null and empty texts have [0]."""

    def table(texts: pa.Array) -> pa.Array:
        c = counter(model_file)
        return pa.array([c.prefix_counts(t) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(table, "array<long>").asNondeterministic()(F.col("text")).alias("counts"))


def truncate_to_budget(docs: DataFrame, budget: int, model_file: str | None = None) -> DataFrame:
    """(doc_id, text, n_tokens): each text cut to the longest prefix of budget tokens at most, read off its table."""

    def cut(texts: pa.Array) -> pa.Array:
        c = counter(model_file)
        text, n = zip(*(c.truncate(t, budget) for t in texts.to_pylist()), strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(n, pa.int64())], ["text", "n"])

    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(cut, "text string, n long").asNondeterministic()(F.col("text")).alias("x"))
    return short.select("doc_id", "x.text", F.col("x.n").alias("n_tokens"))
