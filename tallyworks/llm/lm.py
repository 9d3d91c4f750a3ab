"""Language-model scores by context-tree weighting over bytes.

A text is its words with a blank between them and an end. Every byte is eight binary decisions, each in the contexts of
the last 0, 1, ... ``DEPTH`` bytes, whatever words they belong to. Each context keeps a Krichevsky-Trofimov estimate of its
decisions, and the estimates of all contexts on the way from the root are mixed by the weights that the tree gives them.

A context with the byte after it is a gram, a number whose highest bytes are the nearest ones. Texts are put together
into blocks, and what leaves a block are its distinct grams with their counts, dealt out by their three nearest bytes: all
contexts of three bytes and more then lie in one group, which builds their part of the tree. Shorter contexts are rows
that the groups add to. Each block gets back what its grams cost, and adds up its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.functions.lineage import materialise

# Bytes of the longest context. Contexts of fewer than ``LOW`` bytes are rows of their own.
DEPTH, LOW = 5, 3
# Bytes of a block; a longer text is cut between words.
BLOCK = 8 << 20
# Binary decisions predicted at a time.
AT_ONCE = 1 << 20
END = b"\n"
# What is dealt out: grams and words.
GRAMS, WORDS = 0, 1
MIX = np.uint64(0x9E3779B97F4A7C15)
# Stands for the end among the words.
END_WORD = np.uint64(0)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# --- blocks -------------------------------------------------------------------


def pieces(sequence: bytes, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(bytes before, bytes): a sequence in parts of about ``size`` bytes, cut after a blank; before the first stand ends."""
    at = 0
    while at < len(sequence):
        stop = len(sequence)
        if stop - at > size:
            stop = sequence.rfind(b" ", at, at + size) + 1 or sequence.find(b" ", at + size) + 1 or stop
        yield (END * DEPTH + sequence[max(0, at - DEPTH) : at])[-DEPTH:], sequence[at:stop]
        at = stop


def scattered(x: np.ndarray) -> np.ndarray:
    """A mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """Pieces of texts: each is ``DEPTH`` bytes that stand before it and ``lengths`` bytes of its own."""

    buffer: np.ndarray
    lengths: np.ndarray

    def grams(self) -> np.ndarray:
        """The gram of every byte, in order: the byte, above it those before it, the nearest highest."""
        whole = self.buffer.astype(np.uint64)
        n = len(whole) - DEPTH
        out = whole[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            out |= whole[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH - back + 1))
        return out[self._own()[DEPTH:]]

    def _own(self) -> np.ndarray:
        """Which bytes of the buffer belong to a piece."""
        own = np.ones(len(self.buffer), dtype=bool)
        begins = np.cumsum(self.lengths + DEPTH) - self.lengths - DEPTH
        for k in range(DEPTH):
            own[begins + k] = False
        return own

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of every token, ends among them, and of which piece it is."""
        own = self.buffer[self._own()]
        last = np.flatnonzero((own == 32) | (own == 10))
        sizes = np.diff(np.r_[-1, last])
        place = (np.arange(len(own)) - np.repeat(last - sizes + 1, sizes)).astype(np.uint64)
        h = scattered((own.astype(np.uint64) + (place << np.uint64(8)) + np.uint64(1)) * MIX)
        h[last] = 0
        out = np.add.reduceat(h, last - sizes + 1) if len(last) else np.empty(0, dtype=np.uint64)
        # A blank alone cannot be a token, so an empty one is the end.
        out[(own[last] == 10) & (sizes == 1)] = END_WORD
        # The last word of a text ends with the end: two tokens.
        both = np.flatnonzero((own[last] == 10) & (sizes > 1))
        piece = np.searchsorted(np.cumsum(self.lengths), last, side="right")
        return np.insert(out, both + 1, END_WORD), np.insert(piece, both + 1, piece[both])


def packed(values: np.ndarray, differences: bool = False) -> bytes:
    """Numbers as compressed bytes; of rising ones the differences take least room."""
    values = np.diff(values, prepend=values.dtype.type(0)) if differences else values
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(data: bytes, dtype, differences: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(data), dtype=dtype)
    return np.cumsum(values, dtype=dtype) if differences else values


def dealt(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct keys by bucket and value, and each one's bucket; grams of the same three nearest bytes go together."""
    by = keys >> np.uint64(8 * (DEPTH - LOW + 1)) if kind == GRAMS else keys
    bucket = (scattered((by + np.uint64(1)) * MIX) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, bucket[order]


_BLOCKS = (
    "block long, uids array<long>, ids array<{id}>, lengths array<int>, buffer binary, parts array<struct<kind: int, bucket: int, keys: binary, counts: binary>>"
)


def _blocks(docs: DataFrame, trained: Column, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Texts put together into blocks, each with its distinct grams and words and how often training texts have them."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def parts(block: Block, learns: np.ndarray) -> list[dict]:
        out = []
        words, piece = block.words()
        for what, keys, of in ((GRAMS, block.grams(), np.repeat(learns, block.lengths)), (WORDS, words, learns[piece])):
            label, distinct = pd.factorize(keys)
            counts = np.bincount(label[of], minlength=len(distinct)).astype(np.uint32)
            order, bucket = dealt(distinct, what, buckets)
            distinct, counts = distinct[order], counts[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                out.append({"kind": what, "bucket": int(bucket[a]), "keys": packed(distinct[a:b], True), "counts": packed(counts[a:b])})
        return out

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, made = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size, ids_type = 0, None

        def block() -> pa.RecordBatch:
            lengths = np.array([len(own) for *_, own in held], dtype=np.int64)
            buffer = b"".join(x for *_, before, own in held for x in (before, own))
            found = parts(Block(np.frombuffer(buffer, dtype=np.uint8), lengths), np.array([learns for _, _, learns, *_ in held], dtype=bool))
            columns = [
                pa.array([part << 30 | made]), pa.array([[uid for uid, *_ in held]], pa.list_(pa.int64())), pa.array([[i for _, i, *_ in held]], pa.list_(ids_type)),
                pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())), pa.array([zstandard.compress(buffer, 3)], pa.binary()), pa.array([found], kind),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "uids", "ids", "lengths", "buffer", "parts"])

        for batch in batches:
            ids_type = batch.schema.field("id").type
            for i, learns, text in zip(batch["id"], batch["trained"], batch["text"]):
                uid = part << 40 | texts
                texts += 1
                for before, own in pieces(b" ".join(tokens(text.as_py())) + END, BLOCK):
                    held.append((uid, i.as_py(), learns.as_py(), before, own))
                    size += len(own) + DEPTH
                    if size >= BLOCK:
                        yield block()
                        held, size, made = [], 0, made + 1
        if held:
            yield block()

    return rows.mapInArrow(make, _BLOCKS.format(id=rows.schema["id"].dataType.simpleString()))


# --- the tree -------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series from 8 on, below it by recurrence."""
    shift = np.zeros_like(x, dtype=np.float64)
    x = np.asarray(x, dtype=np.float64).copy()
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


@dataclass
class Nodes:
    """Decisions within contexts of one length, by key (context, then the bits decided before): counts and the log of the
    weighted probability of what training saw there."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray

    def stop(self) -> np.ndarray:
        """The share of a context's own estimate; the rest is its children's."""
        return np.exp(estimate(self.zeros, self.ones) - math.log(2) - self.weighted)

    def one(self) -> np.ndarray:
        """The context's own probability of a one."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, decision): keys of the eight decisions of each gram's byte in its longest context, and whether they are ones."""
    byte, context = grams & np.uint64(255), grams >> np.uint64(8)
    j = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << j)[None, :] | (byte[:, None] >> (np.uint64(8) - j)[None, :])
    return context[:, None] << np.uint64(8) | node, (byte[:, None] >> (np.uint64(7) - j)[None, :] & np.uint64(1)).astype(bool)


def shorter(keys: np.ndarray, bytes_less: int = 1) -> np.ndarray:
    """The same decisions in contexts without their farthest bytes."""
    return keys >> np.uint64(8 * (bytes_less + 1)) << np.uint64(8) | keys & np.uint64(255)


def merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(at, weights=v, minlength=len(distinct)) for v in values)


def grown(grams: np.ndarray, counts: np.ndarray) -> list[Nodes]:
    """Nodes of contexts of ``LOW`` to ``DEPTH`` bytes for distinct grams with how often training has them; those it has."""
    seen = counts > 0
    keys, bits = decisions(grams[seen])
    n = np.repeat(counts[seen].astype(np.float64), 8).reshape(-1, 8)
    keys, zeros, ones = merged(keys.ravel(), np.where(bits, 0.0, n).ravel(), np.where(bits, n, 0.0).ravel())
    levels = [Nodes(keys, zeros, ones, estimate(zeros, ones))]
    for _ in range(DEPTH - LOW):
        below = levels[-1]
        keys, zeros, ones, inside = merged(shorter(below.keys), below.zeros, below.ones, below.weighted)
        levels.append(Nodes(keys, zeros, ones, np.logaddexp(estimate(zeros, ones), inside) - math.log(2)))
    return levels[::-1]


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among the sorted ones, and where."""
    if not len(keys):
        return np.zeros(wanted.shape, dtype=bool), np.zeros(wanted.shape, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def step(said, left, visited, stop, one, below) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one said so far, and the share left to longer contexts, after a context.

    A context that training visited keeps its share and leaves the rest to the next longer one; all of it stays where that was
    not visited (``below``).
    """
    share = np.where(below, stop, 1.0)
    return np.where(visited, said + left * share * one, said), np.where(visited, left * (1 - share), left)


def costs(grams: np.ndarray, levels: list[Nodes], states: dict[str, np.ndarray]) -> np.ndarray:
    """Log10 of the probability of each gram's byte after its context.

    ``states`` has for each decision in contexts of ``LOW`` - 1 bytes: ``key``, what was ``said`` and is ``left`` before it,
    and its own ``stop``, ``one`` and ``visited``.
    """
    out = np.empty(len(grams))
    stops, ones = [x.stop() for x in levels], [x.one() for x in levels]
    for at in range(0, len(grams), AT_ONCE // 8):
        keys, bits = decisions(grams[at : at + AT_ONCE // 8])
        _, place = found(states["key"], shorter(keys, DEPTH - LOW + 1))
        said, left, visited, stop, one = (states[c][place] for c in ("said", "left", "visited", "stop", "one"))
        for i, level in enumerate(levels):
            below, where = found(level.keys, shorter(keys, DEPTH - LOW - i) if i < DEPTH - LOW else keys)
            said, left = step(said, left, visited, stop, one, below)
            if len(level.keys):
                visited, stop, one = below, stops[i][where], ones[i][where]
            else:
                visited = below
        said, left = step(said, left, visited, stop, one, np.zeros(said.shape, dtype=bool))
        out[at : at + AT_ONCE // 8] = np.log10(np.where(bits, said, 1 - said)).sum(1)
    return out


# --- groups -------------------------------------------------------------------


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a bucket, their counts over all blocks, every block's keys' places among them, and how many each block has."""
    keys = [unpacked(x.as_py(), np.uint64, True) for x in table["keys"]]
    counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table["counts"]])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64), at, [len(k) for k in keys]


def _answers(table: pa.Table, kind: int, values: np.ndarray, sizes: list[int], extra: dict[str, list]) -> pa.Table:
    """A row per block: the values of its keys, in their order."""
    cuts = np.cumsum([0, *sizes])
    payload = [packed(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    columns = {"block": table["block"], "kind": pa.array([kind] * len(sizes), pa.int32()), "bucket": table["bucket"], "payload": pa.array(payload, pa.binary())}
    return pa.table(columns | extra)


_ANSWER = "block long, kind int, bucket int, payload binary"


def _word_counts(parts: DataFrame) -> DataFrame:
    """Each block's words' counts in training, with the number of tokens and distinct ones of a bucket on one row of it."""

    def count(table: pa.Table) -> pa.Table:
        _, counts, at, sizes = _arrays(table)
        rest = [0] * (table.num_rows - 1)
        extra = {"n": pa.array([int(counts.sum()), *rest]), "v": pa.array([int((counts > 0).sum()), *rest])}
        return _answers(table, WORDS, counts[at], sizes, extra)

    return parts.where(F.col("kind") == WORDS).select("block", "bucket", "keys", "counts").groupBy("bucket").applyInArrow(count, _ANSWER + ", n long, v long")


def _contributions(parts: DataFrame) -> DataFrame:
    """(bucket, key, zeros, ones, inside): what each bucket's part of the tree adds to contexts of ``LOW`` - 1 bytes.

    Also for decisions that training never met, with counts of 0.
    """

    def grow(table: pa.Table) -> pa.Table:
        grams, counts, *_ = _arrays(table)
        lowest = grown(grams, counts)[0]
        every = np.unique(shorter(decisions(grams)[0].ravel(), DEPTH - LOW + 1))
        keys, zeros, ones, inside = merged(
            np.concatenate([shorter(lowest.keys), every]),
            *(np.concatenate([x, np.zeros(len(every))]) for x in (lowest.zeros, lowest.ones, lowest.weighted)),
        )
        bucket = pa.array([table["bucket"][0].as_py()] * len(keys), pa.int32())
        return pa.table({"bucket": bucket, "key": keys.astype(np.int64), "zeros": zeros, "ones": ones, "inside": inside})

    schema = "bucket int, key long, zeros double, ones double, inside double"
    return parts.where(F.col("kind") == GRAMS).select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(grow, schema)


def _weighted(sums: DataFrame) -> DataFrame:
    """(key, zeros, ones, weighted) of (key, zeros, ones, inside): the sums of what the next longer contexts have."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, inside = (batch[c].to_numpy() for c in ("zeros", "ones", "inside"))
            weighted = np.where(zeros + ones > 0, np.logaddexp(estimate(zeros, ones), inside) - math.log(2), 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["zeros"], batch["ones"], pa.array(weighted)], ["key", "zeros", "ones", "weighted"])

    return sums.mapInArrow(weigh, "key long, zeros double, ones double, weighted double")


def _level(nodes: pd.DataFrame) -> Nodes:
    ordered = nodes.sort_values("key")
    return Nodes(*(ordered[c].to_numpy() for c in ("key", "zeros", "ones", "weighted")))


def _states(level: DataFrame, spark) -> DataFrame:
    """(key, said, left, visited, stop, one) for the decisions in contexts of two bytes, of their ``level`` of the tree.

    Contexts of one byte and none are at most 65,535 decisions, which the driver weighs and every task receives.
    """
    less = ((F.shiftright("key", 16) * 256) + F.col("key").bitwiseAND(F.lit(255))).alias("key")
    sums = level.groupBy(less).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("inside"))
    first = _level(_weighted(sums).toPandas())
    keys, zeros, ones, inside = merged(first.keys & 255, first.zeros, first.ones, first.weighted)
    root = Nodes(keys, zeros, ones, np.where(zeros + ones > 0, np.logaddexp(estimate(zeros, ones), inside) - math.log(2), 0.0))

    def visited(nodes: Nodes) -> np.ndarray:
        return nodes.zeros + nodes.ones > 0

    at = np.searchsorted(root.keys, first.keys & 255)
    # What no training text decided is a half.
    start = np.where(visited(root)[at], 0.0, 0.5), np.where(visited(root)[at], 1.0, 0.0)
    said, left = step(*start, visited(root)[at], root.stop()[at], root.one()[at], visited(first))
    sent = spark.sparkContext.broadcast((first.keys, said, left, visited(first), first.stop(), first.one()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, said, left, visited, stop, one = sent.value
        for batch in batches:
            own = Nodes(*(batch[c].to_numpy() for c in ("key", "zeros", "ones", "weighted")))
            seen = own.zeros + own.ones > 0
            at = np.searchsorted(keys, (own.keys >> 16 << 8) | own.keys & 255)
            now = step(said[at], left[at], visited[at], stop[at], one[at], seen)
            values = [own.keys, *now, seen, own.stop(), own.one()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["key", "said", "left", "visited", "stop", "one"])

    return level.mapInArrow(run, "key long, said double, left double, visited boolean, stop double, one double")


def _gram_costs(parts: DataFrame, states: DataFrame) -> DataFrame:
    """Each block's grams' costs. ``states`` has a bucket's decisions in contexts of ``LOW`` - 1 bytes."""

    def cost(table: pa.Table, states: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        grams, counts, at, sizes = _arrays(table)
        states = states.sort_by("key")
        held = {c: states[c].to_numpy() for c in ("key", "said", "left", "visited", "stop", "one")}
        held["key"] = held["key"].astype(np.uint64)
        return _answers(table, GRAMS, costs(grams, grown(grams, counts), held).astype(np.float32)[at], sizes, {})

    mine = parts.where(F.col("kind") == GRAMS).select("block", "bucket", "keys", "counts")
    return mine.groupBy("bucket").cogroup(states.groupBy("bucket")).applyInArrow(cost, _ANSWER)


_SUMS = "uid long, doc_id {id}, n_tokens long, n_known long, base_score double, score double"


def _summed(blocks: DataFrame, answers: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    """Every piece's tokens, how many training knows, and both scores."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def add(block: pa.Table, answers: pa.Table) -> pa.Table:
        lengths = np.asarray(block["lengths"][0].as_py(), dtype=np.int64)
        own = Block(np.frombuffer(zstandard.decompress(block["buffer"][0].as_py()), dtype=np.uint8), lengths)
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])

        def answered(keys: np.ndarray, kind: int, dtype) -> np.ndarray:
            label, distinct = pd.factorize(keys)
            values = np.empty(len(distinct), dtype=dtype)
            payload = [p.as_py() for k, p in zip(answers["kind"], answers["payload"]) if k.as_py() == kind]
            values[dealt(distinct, kind, buckets)[0]] = np.concatenate([unpacked(p, dtype) for p in payload])
            return values[label]

        score = np.add.reduceat(answered(own.grams(), GRAMS, np.float32), np.cumsum(lengths) - lengths, dtype=np.float64)
        words, piece = own.words()
        counts = answered(words, WORDS, np.int64)
        base = np.log10((counts + 1.0) / (n + v + 1.0))
        m = len(lengths)
        return pa.table(
            {
                "uid": pa.array(block["uids"][0].as_py(), pa.int64()), "doc_id": block["ids"].combine_chunks().flatten(),
                "n_tokens": np.bincount(piece, minlength=m), "n_known": np.bincount(piece, weights=counts > 0, minlength=m).astype(np.int64),
                "base_score": np.bincount(piece, weights=base, minlength=m), "score": score,
            }
        )

    texts = blocks.select("block", "uids", "ids", "lengths", "buffer")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, _SUMS.format(id=id_type))


def scored(docs: DataFrame, trained: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    ``trained`` is a condition on ``docs``: the texts learnt from; null is no. Scores are log10 probabilities of whole texts, ``base_score`` by single
    tokens (words and an end), ``score`` by the context tree. Null texts are empty: their end alone. Repeated rows count and
    score each; an empty table gives no rows; without training texts every decision is a half.

    Counts are of all training texts. A block has one gram a byte at most; a bucket holds the grams of some
    three-byte contexts, so both grow with the texts only where they say something new.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialise(_blocks(docs, trained, id_col, text_col, buckets), "blocks")
    parts = blocks.select("block", F.inline("parts"))
    words = materialise(_word_counts(parts), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    mine = materialise(_contributions(parts), "contributions")
    sums = mine.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("inside").alias("inside"))
    level = materialise(_weighted(sums), "level")
    states = mine.select("bucket", "key").join(_states(level, spark), "key")
    grams = _gram_costs(parts, states)
    answers = words.select("block", "kind", "bucket", "payload").union(grams)
    pieces_summed = _summed(blocks, answers, buckets, n, v)
    by_text = pieces_summed.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    return by_text.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
