"""Packing documents into sequences of at most so many tokens, by the histogram of lengths.

Lengths are placed longest first, each on the shortest packs that have room, all packs of one
length and history at once: a run of packs is a row of counts, whatever number of documents it
stands for. Documents meet the plan again by their rank among pieces of the same length.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tallyworks.functions.lineage import stage_path

MAX_LENGTH = 2048
END_ID = 1
# Distinct parts of words whose ids a worker remembers, in two generations: once the younger has half, the older is
# dropped, but for the parts met again since. Some 200 bytes each.
WORDS_REMEMBERED = 400_000


# --- tokens -------------------------------------------------------------------


# ASCII signs.
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
# Texts whose words are looked up together: at most so many, and of so many bytes unless one alone is longer.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 4096, 4 << 20
RUNS_AT_ONCE = 64
# Pieces that a task sends back together, or those of one document if it has more.
PIECES_AT_ONCE = 1024


def _small_letters(word: bytes) -> bool:
    """Whether a word is letters only, in small and composed form, which normalising leaves alone."""
    if word.isascii():
        return word.isalpha() and word.islower()
    text = word.decode("utf-8")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


def _spans(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Spans of ``flat`` behind each other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where each begins if they follow each other, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)])


class WordTokens:
    """Ids of texts by a tokenizer whose pieces never span white space, word by word.

    Arrow splits a group of texts and numbers their distinct words, NumPy puts the ids of these behind each
    other, so Python sees a word once a group. A byte-pair tokenizer that ignores case and parts letters
    from signs gives ``Word!!`` the ids of ``word`` and of ``!!``, so only such parts are looked up and
    remembered. Small letters need no normalising, so they go to its merges alone, many to a call, and the
    ids that end a word tell them apart again. Ids are held in the narrowest type the vocabulary fits.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        split = json.dumps(made["pre_tokenizer"]).replace("\\\\", "\\")
        suffix = made["model"].get("end_of_word_suffix")
        folds = "Lowercase" in json.dumps(made["normalizer"])
        self.merges = None
        if folds and r"[^\s\p{L}\p{N}]+" in split and '"ByteLevel"' in split and suffix:
            levels = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
            bare = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": levels}}
            self.merges = Tokenizer.from_str(json.dumps(made | bare))
            self.ends = np.zeros(size, dtype=bool)
            self.ends[[i for t, i in made["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _parts(self, words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
        """The letters of each word and the signs after them; of words that are anything but that the whole, and nothing.

        Words with letters beyond ASCII must have no ASCII capital: how a capital goes together with an accent is
        the tokenizer's affair.
        """
        if not self.merges:
            return words, pa.array([""] * len(words), pa.string())
        low = pc.ascii_lower(words)
        letters = pc.ascii_rtrim(low, characters=_SIGNS)
        apart = pc.and_(pc.utf8_is_alpha(letters), pc.or_(pc.string_is_ascii(letters), pc.equal(low, words)))
        first = pc.if_else(apart, letters, words)
        # Both are as long as the word, so the signs are the bytes of ``low`` from where the letters end.
        n = pc.binary_length(first).to_numpy()
        at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        rest = np.diff(at) - n
        signs = _spans(np.frombuffer(low.buffers()[2] or b"", np.uint8), at[:-1] + n, rest)
        return first, pa.StringArray.from_buffers(len(low), pa.py_buffer(_starts(rest).astype(np.int32)), pa.py_buffer(signs))

    def _learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new words."""
        runs, others = [], []
        for w in words:
            (runs if self.merges and _small_letters(w) else others).append(w)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in others], add_special_tokens=False)
        self.ids.update((w, np.array(e.ids, dtype=self.dtype).tobytes()) for w, e in zip(others, found))
        calls = [runs[i : i + RUNS_AT_ONCE] for i in range(0, len(runs), RUNS_AT_ONCE)]
        found = self.merges.encode_batch_fast([b" ".join(c).decode("utf-8") for c in calls]) if calls else []
        for call, e in zip(calls, found):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()]
            whole = ids.tobytes()
            self.ids.update((w, whole[a:b]) for w, a, b in zip(call, cuts, cuts[1:], strict=False))

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, the new ones learnt."""
        if len(self.ids) > WORDS_REMEMBERED // 2:
            self.ids, self.older = {}, self.ids
        found = list(map(self.ids.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [words[i] for i in missing]
            self.ids.update((w, self.older[w]) for w in new if w in self.older)
            self._learn([w for w in new if w not in self.ids])
            for i, w in zip(missing, new):
                found[i] = self.ids[w]
        return found

    def _group(self, texts: pa.StringArray) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts behind each other, and where each begins and the last ends."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        first, signs = self._parts(words.dictionary)
        parts = pa.concat_arrays([first, signs]).dictionary_encode()
        found = self._looked_up(parts.dictionary.cast(pa.binary()).to_pylist())
        n = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        # A row of two for each distinct word, then the distinct words in their places in the texts.
        of = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        flat = _spans(np.frombuffer(b"".join(found), self.dtype), _starts(n)[of], n[of])
        n = n[of].reshape(-1, 2).sum(1)
        places = words.indices.to_numpy()
        n, starts = n[places], _starts(n)[places]
        offsets = _starts(pc.list_value_length(split).to_numpy())
        return _spans(flat, starts, n), _starts(n)[offsets].tolist()

    def of(self, texts: pa.StringArray | list[str | None]) -> Iterator[bytes]:
        """The ids of each text as bytes; none for null."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        before, at = _starts(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            within = int(np.searchsorted(before, before[at] + BYTES_AT_ONCE, "right")) - 1
            to = min(max(within, at + 1), at + TEXTS_AT_ONCE)
            ids, cuts = self._group(texts.slice(at, to - at))
            for a, b in zip(cuts, cuts[1:]):
                yield ids[a:b].tobytes()
            at = to


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokens(path)


_PIECES = (
    "part int, place long, doc_id {id}, start long, length long, doc_tokens long, ids binary"
)


def _cut(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, max_length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``max_length`` tokens, with their place among equally long ones of their task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = word_tokens(tokenizer_path), TaskContext.get().partitionId()
        size, end = tokens.dtype.itemsize, np.array([end_id], dtype=tokens.dtype).tobytes()
        seen = np.zeros(max_length + 1, dtype=np.int64)
        def made(batch: pa.RecordBatch, rows: list[int], pieces: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*pieces)] if pieces else [pa.array([], t) for t in [pa.int64()] * 4 + [pa.binary()]]
            place, starts, lengths, totals, parts = columns
            of = [pa.array([part] * len(rows), pa.int32()), place, batch.column(0).take(pa.array(rows, pa.int64())), starts, lengths, totals, parts]
            return pa.RecordBatch.from_arrays(of, ["part", "place", "doc_id", "start", "length", "doc_tokens", "ids"])

        for batch in batches:
            rows, pieces = [], []
            for row, ids in enumerate(tokens.of(batch.column(1))):
                ids += end
                n = len(ids) // size
                for start in range(0, n, max_length):
                    length = min(max_length, n - start)
                    pieces.append((seen[length], start, length, n, ids[start * size : (start + length) * size]))
                    seen[length] += 1
                    rows.append(row)
                if len(rows) >= PIECES_AT_ONCE:
                    yield made(batch, rows, pieces)
                    rows, pieces = [], []
            yield made(batch, rows, pieces)

    schema = _PIECES.format(id=docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(cut, schema)


# --- the plan -----------------------------------------------------------------


def packed_runs(histogram: dict[int, int], max_length: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: (length, first rank, rank after the last, sequence of the first, offset).

    A run of packs is (used, first sequence, number). Pieces of the longest length come first. The
    shortest packs take them as long as they have room, one piece each; the rest open new packs.
    Every step uses up a run or a length, so there are at most a few runs per length.
    """
    packs: list[tuple[int, int, int]] = []
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= max_length:
                used, first, number = heapq.heappop(packs)
            else:
                used, first, number = 0, opened, left
                opened += left
            n = min(left, number)
            runs.append((length, rank, rank + n, first, used))
            if used + length < max_length:
                heapq.heappush(packs, (used + length, first, n))
            if n < number:
                heapq.heappush(packs, (used, first + n, number - n))
            rank, left = rank + n, left - n
    return runs


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone.
    Documents longer than ``max_length`` are cut. ``ids`` are unsigned 32-bit little-endian numbers.
    A sequence's pieces follow each other from offset 0 without gaps. Repeated rows are documents of
    their own; a null id stays null; other columns are left out. An empty table gives no pieces.

    The pieces are written once. The driver sees their histogram and sends the plan, both bounded
    by ``max_length``. Ranks are a task's counts by length plus those of the tasks before it.
    """
    spark = docs.sparkSession
    path = stage_path(spark, "pieces")
    cut = _cut(docs, tokenizer_path, id_col, text_col, max_length, end_id)
    cut.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(cut.schema).parquet(path)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = packed_runs(histogram, max_length)
    plan = spark.createDataFrame(
        pd.DataFrame(runs, columns=["run_length", "from_rank", "to_rank", "first_sequence", "offset"]).astype("int64"),
        "run_length long, from_rank long, to_rank long, first_sequence long, offset long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("first_rank") + F.col("place"))
    # The plan has at most some runs per length, however many pieces there are.
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    )
    sequence = F.col("first_sequence") + F.col("rank") - F.col("from_rank")
    narrow = placed.select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), "offset")
    return narrow.withColumn("ids", _widened("ids", "length"))


@F.pandas_udf(T.BinaryType())
def _widened(ids: pd.Series, length: pd.Series) -> pd.Series:
    """Ids as 32-bit numbers, from whichever width they are held in."""
    return pd.Series([np.frombuffer(b, f"<u{len(b) // n}").astype("<u4").tobytes() for b, n in zip(ids, length)], dtype=object)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens, doc_lengths) of packed pieces: the ids of a sequence in order and
    the lengths of its parts, for a mask that keeps documents apart."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most max_length of them
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.array_join(F.transform("p.ids", F.hex), "").alias("hex"),
        F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
        F.col("p.length").alias("doc_lengths"),
    ).select("sequence_id", F.unhex("hex").alias("ids"), "n_tokens", "doc_lengths")
