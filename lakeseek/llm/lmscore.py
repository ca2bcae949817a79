"""Cross-entropy difference: target and background bigram models over one vocabulary.

A text is <s> w1 ... wn </s>. The vocabulary is every word, known by its XXH64, and
word and pair counts are exact over all documents, so what is gathered grows with the
corpus at any size. Nothing of the models is broadcast or brought to the driver:

- texts are tokenised once, into blocks of BLOCK tokens, written to the shared folder:
  a block has its own word numbers, and how long each document is;
- a block asks once for each different word and pair that it has, whatever its count
  there. Questions are sorted keys, dealt by key range into buckets, so a word that is
  a third of all tokens is one question a block;
- a bucket adds up what the blocks say and answers each block with the counts that are
  more than its own; what has no answer was seen in this block only;
- each block, met by its answers, scores its documents.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a block, and questions of a bucket, about.
BLOCK = 1 << 21
#: Weight of the bigram share against the smoothed word share, and the smoothing.
MIX, ADD = 0.6, 0.1
#: Target ids up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

#: Ids that no word has, and how many words the models allow for that no text has.
START, END = 1, 2
UNSEEN = 1
_PART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """XXH64 of each word, never START or END."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PART).split()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    return np.where(ids <= END, np.uint64(END + 1), ids)


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit ids of pairs of word ids."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ x >> np.uint64(32)) + b) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, as planes of as many bytes as the largest needs, compressed."""
    x = np.ascontiguousarray(x).astype(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<BQ", width, len(x)) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


_BLOCK = "block long, tokens long, doc_ids array<long>, lengths binary, target binary, vocabulary binary, stream binary"


def _blocks(size: int):
    """mapInArrow function (doc_id, text, target) -> blocks. Arrays of bytes: words a document; which are targets; its words, sorted; each word of the texts by its place there."""
    schema = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("lengths", "target", "vocabulary", "stream"))])

    def run(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        ids, target, words, n = [], [], [], 0

        def block():
            every = np.concatenate(words)
            known, stream = np.unique(every, return_inverse=True)
            row = [part + made], [len(every) + len(ids)], [ids], [pack(np.array([len(w) for w in words]))], [pack(np.array(target))], [pack(_gaps(known))], [pack(stream)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, text, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                target.append(t)
                words.append(word_ids(text.as_py()))
                n += len(words[-1]) + 1
                if n >= size:
                    yield block()
                    made += 1
                    ids, target, words, n = [], [], [], 0
        if ids:
            yield block()

    return run


class Block:
    """What a block asks for: sorted keys of its words and of its pairs, with their counts there."""

    def __init__(self, lengths: bytes, target: bytes, vocabulary: bytes, stream: bytes):
        self.lengths, self.target = unpack(lengths).astype(np.int64), unpack(target).astype(bool)
        known = np.cumsum(unpack(vocabulary), dtype=np.uint64)
        has = self.lengths > 0  # a text without a word has no start and no end
        n, target = self.lengths[has] + 1, self.target[has]
        self.words = np.concatenate([np.array([START, END], np.uint64), known])  # sorted: no word is less
        ends = np.cumsum(n) - 1
        after = np.ones(int(n.sum()), np.int64)
        inner = np.ones(len(after), bool)
        inner[ends] = False
        after[inner] = unpack(stream).astype(np.int64) + 2
        before = np.concatenate([[0], after[:-1]]).astype(np.int64) if len(after) else after
        before[ends[:-1] + 1] = 0
        weight, docs = np.repeat(target, n), np.bincount([0] * len(n), target, 1) if len(n) else np.zeros(1)
        self.word_b, self.word_t = np.bincount(after, minlength=len(self.words)), np.bincount(after, weight, len(self.words)).astype(np.int64)
        self.word_b[0], self.word_t[0] = len(n), int(docs[0])
        key = pair_ids(self.words[before], self.words[after])
        self.pairs, first, self.at, self.pair_b = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.pair_t = np.bincount(self.at, weight, len(self.pairs)).astype(np.int64)
        self.before, self.after = before[first], after[first]
        self.first = ends - n + 1  # where each document that has words begins

    def losses(self, totals: tuple[int, int], size: int) -> np.ndarray:
        """Mean bits of each document under either model, from the counts that the block has by now."""
        out, has = np.zeros((2, len(self.lengths))), self.lengths > 0
        for k, (pair, word) in enumerate(((self.pair_t, self.word_t), (self.pair_b, self.word_b))):
            before, one = word[self.before], (word[self.after] + ADD) / (totals[k] + ADD * size)
            bits = -np.log2(np.where(before > 0, MIX * pair / np.maximum(before, 1) + (1 - MIX) * one, one))
            if has.any():
                out[k, has] = np.add.reduceat(bits[self.at], self.first) / (self.lengths[has] + 1)
        return out


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted keys part into buckets, which are equal ranges of keys."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _ask(pairs: int, words: int):
    """mapInArrow function blocks -> (bucket, block, keys, t, b): what each asks of the buckets. The buckets of words come after those of pairs."""
    names = ["bucket", "block", "asked", "t", "b"]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                block, *data = (batch.column(c)[r].as_py() for c in (0, 3, 4, 5, 6))
                x = Block(*data)
                rows = []
                for keys, t, b, n, start in ((x.pairs, x.pair_t, x.pair_b, pairs, 0), (x.words, x.word_t, x.word_b, words, pairs)):
                    cuts = _cuts(keys, n) if n else [0]
                    rows += [(start + k, block, pack(_gaps(keys[i:j])), pack(t[i:j]), pack(b[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return run


_ASKED = "bucket long, block long, asked binary, t binary, b binary"


def _buckets(batches):
    """(bucket, block, keys, t, b) sorted by bucket -> for each bucket, its blocks, keys, and what the keys add up to; holds one bucket."""
    held: list[tuple] = []

    def bucket():
        asked = [np.cumsum(unpack(r[2]), dtype=np.uint64) for r in held]
        t, b = ([unpack(r[k]).astype(np.int64) for r in held] for k in (3, 4))
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = [np.bincount(at, np.concatenate(x), len(keys)).astype(np.int64) for x in (t, b)]  # exact up to 2^53
        return held[0][0], [r[1] for r in held], keys, np.split(at, np.cumsum([len(x) for x in asked])[:-1]), b, *sums

    for batch in batches:
        for r in range(batch.num_rows):
            row = tuple(c[r].as_py() for c in batch.columns)
            if held and held[0][0] != row[0]:
                yield bucket()
                held.clear()
            held.append(row)
    if held:
        yield bucket()


def _totals(batches):
    """Asked words -> (t, b, words): tokens of either model and different words, a row a bucket."""
    for _, _, keys, _, _, t, b in _buckets(batches):
        yield pa.RecordBatch.from_pydict({"t": [int(t[keys != START].sum())], "b": [int(b[keys != START].sum())], "words": [int((keys > END).sum())]})


_ANSWER = "block long, bucket long, more binary, t binary, b binary"


def _answer(batches):
    """What blocks ask -> for each, which keys others have too (bits, in the order asked), and their counts over all blocks."""
    names = [f.split()[0] for f in _ANSWER.split(", ")]
    for bucket, blocks, _, places, own, t, b in _buckets(batches):
        rows = []
        for block, at, mine in zip(blocks, places, own, strict=True):
            more = b[at] > mine
            if more.any():
                rows.append((block, bucket, np.packbits(more).tobytes(), pack(t[at[more]]), pack(b[at[more]])))
        for i in range(0, len(rows), 100):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 100], strict=True)], names)


_SCORES = "doc_id long, n_words long, target_bits double, background_bits double, score double"


def _score(pairs: int, words: int, totals: tuple[int, int], size: int):
    """Cogroup function: a block and its answers -> the scores of its documents."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        x = Block(*(blocks.column(k)[0].as_py() for k in ("lengths", "target", "vocabulary", "stream")))
        cuts = {0: _cuts(x.pairs, pairs), pairs: _cuts(x.words, words)}
        for bucket, more, t, b in zip(*(answers.column(k).to_pylist() for k in ("bucket", "more", "t", "b")), strict=True):
            start = pairs if bucket >= pairs else 0
            i, j = cuts[start][bucket - start : bucket - start + 2]
            at = i + np.flatnonzero(np.unpackbits(np.frombuffer(more, np.uint8), count=j - i))
            of_t, of_b = (x.word_t, x.word_b) if start else (x.pair_t, x.pair_b)
            of_t[at], of_b[at] = unpack(t), unpack(b)
        t, b = np.round(x.losses(totals, size), 9)
        return pa.table({"doc_id": blocks.column("doc_ids")[0].values, "n_words": pa.array(x.lengths), "target_bits": t, "background_bits": b, "score": np.round(t - b, 9)})

    return run


def lm_scores(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, target_bits, background_bits, score) for each row.

    Target documents are those with labels.quality = 1, background is all documents.
    score: mean over the words and the end of target loss less background loss, in
    bits (to 9 places); lower is nearer to the target. Null texts are empty; without a
    word all are 0. With no target document the target model is uniform. Repeated rows
    count, and are returned, as often as they come. An empty table gives an empty table.
    Scores don't depend on block, the tokens that a task holds; a longer text is a block.
    """
    from .common import cut

    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("t_id"), "left")
    blocks = cut(rows.select("doc_id", "text", F.col("t_id").isNotNull().alias("target")).mapInArrow(_blocks(block), _BLOCK), "lm-blocks")

    buckets = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // block))
    few = -(-buckets // 4)  # a block has fewer words than pairs
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda asked: asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    *totals, n_words = dealt(blocks.mapInArrow(_ask(0, few), _ASKED)).mapInArrow(_totals, "t long, b long, words long").agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("t", "b", "words"))).first()
    answers = dealt(blocks.mapInArrow(_ask(buckets, few), _ASKED)).mapInArrow(_answer, _ANSWER)
    score = _score(buckets, few, tuple(totals), n_words + 2 + UNSEEN)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES)
