"""Languages of texts, also of texts that mix them.

A word is a maximal run of letters. Its script narrows the languages it may be in; for each of them it has
a score, the logarithm of the likelihood of its character n-grams. Viterbi decoding over the words of a text,
with a penalty for every change of language, labels spans; the text's language is that of most of its letters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNKNOWN = "und"
# N-grams of 1 to 4 characters of "<word>", each length hashed into buckets of its own.
LENGTHS, BUCKETS = (1, 2, 3, 4), 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)
# What a change of language costs, in nats; and the count that every n-gram has besides its own.
SWITCH, PRIOR = 8.0, 0.5
# A language stays a candidate for a script in which at least this share of its words is written.
SCRIPT_SHARE = 0.01
# Characters read at a time, and texts of one output batch.
LETTERS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 512
EXCLUDED = -1e4

# First and last code point of the main ranges of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1


class Characters:
    """Of every code point: whether it is a letter, its lower case and its script (0: none of those listed)."""

    def __init__(self):
        points = 0x110000
        self.letter, self.script = np.zeros(points, dtype=bool), np.zeros(points, dtype=np.uint8)
        self.lower = np.arange(points, dtype=np.uint32)
        for p in range(0x323B0):
            c = chr(p)
            if c.isalpha():
                self.letter[p] = True
                low = c.lower()
                if len(low) == 1:
                    self.lower[p] = ord(low)
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for first, last in ranges:
                self.script[first : last + 1] = i


_characters: list[Characters] = []


def characters() -> Characters:
    """The worker's table of characters."""
    if not _characters:
        _characters.append(Characters())
    return _characters[0]


@dataclass
class Words:
    """Words in order: where each begins, its number of letters, its script, and all letters in lower case.

    ``distinct`` has the place of the first of every distinct word, ``same`` for each word its place there.
    """

    starts: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray
    letters: np.ndarray
    distinct: np.ndarray = field(init=False)
    same: np.ndarray = field(init=False)

    def __post_init__(self):
        ends = np.cumsum(self.sizes)
        if not len(ends):
            self.distinct = self.same = np.empty(0, dtype=np.int64)
            return
        place = (np.arange(len(self.letters)) - np.repeat(ends - self.sizes, self.sizes)).astype(np.uint64)
        # A word is told from others by the 64-bit sum of its letters' hashes by place.
        h = (self.letters + (place << np.uint64(21)) + np.uint64(1)) * MIX
        h = (h ^ (h >> np.uint64(29))) * MIX
        h ^= h >> np.uint64(32)
        self.same, kinds = pd.factorize(np.add.reduceat(h, ends - self.sizes))
        self.distinct = np.empty(len(kinds), dtype=np.int64)
        # Written backwards, so that the first of equal words stays.
        self.distinct[self.same[::-1]] = np.arange(len(ends) - 1, -1, -1)

    def kinds(self, at_once: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Distinct words in slices of about ``at_once`` letters: the slice, their sizes and letters."""
        ends = np.cumsum(self.sizes)
        sizes = self.sizes[self.distinct]
        total = np.cumsum(sizes)
        first = 0
        while first < len(total):
            before = int(total[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + at_once, side="right")))
            mine, begin = sizes[first:last], (ends - self.sizes)[self.distinct[first:last]]
            inner = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
            yield slice(first, last), mine, self.letters[np.repeat(begin, mine) + inner]
            first = last


def words_of(text: str) -> Words:
    """Maximal runs of letters, in code points; a word's script is that of its first letter."""
    table = characters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = np.zeros(len(points) + 2, dtype=bool)
    letter[1:-1] = table.letter[points]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    return Words(starts, ends - starts, table.script[points[starts]], table.lower[points[letter[1:-1]]].astype(np.uint64))


def together(texts: list[str], at_once: int = LETTERS_AT_ONCE) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``at_once`` characters, a longer one alone: the words of a group, where each
    text's words begin and end among them, and where each text begins among the characters."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) < at_once:
            size += len(texts[last])
            last += 1
        words = words_of("\n".join(texts[first:last]))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        yield words, np.searchsorted(words.starts, begins), begins
        first = last


def ngrams(sizes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: its place in ``LENGTHS``, the buckets of its n-grams, and the word each belongs to."""
    room = sizes + 2
    ends = np.cumsum(room)
    # Marks 0 and 1 stand around each word.
    marked = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    of = np.repeat(np.arange(len(sizes)), room)
    inner = np.ones(len(marked), dtype=bool)
    inner[ends - room] = inner[ends - 1] = False
    marked[ends - room], marked[ends - 1], marked[inner] = 0, 1, letters
    left = ends[of] - np.arange(len(marked))
    h = np.zeros(len(marked), dtype=np.uint64)
    for i, n in enumerate(LENGTHS):
        h = h[: len(marked) - n + 1]
        h = (h ^ marked[n - 1 :]) * MIX
        h ^= h >> np.uint64(31)
        # Marks alone are no n-grams.
        inside = np.flatnonzero(left[: len(h)] >= n) if n > 1 else np.flatnonzero(inner)
        yield i, ((h[inside] >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64), of[inside]


@dataclass
class LanguageModel:
    """Learned languages in code-point order, each one's scores of n-grams (by length and bucket) and the scripts it may have."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """(word, language): the mean over n-gram lengths of the log-likelihood; far below any where the script excludes the language."""
        out = np.zeros((len(self.languages), len(words.distinct)))
        for some, sizes, letters in words.kinds(LETTERS_AT_ONCE):
            for i, buckets, of in ngrams(sizes, letters):
                if not len(buckets):
                    continue
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                at = some.start + of[starts]
                for mine, scores in zip(out, self.scores):
                    mine[at] += np.add.reduceat(scores[i * BUCKETS : (i + 1) * BUCKETS][buckets], starts) / len(LENGTHS)
        out += np.where(self.scripts[:, words.scripts[words.distinct]], 0.0, EXCLUDED)
        return out.T[words.same]


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the path of the highest sum of scores less ``switch`` per change.

    Ties go to staying and to the language that comes first. Where no stretch of another language gains
    more than half a change over the best single one, that one is the path: a path with k stretches of
    others gains at most k halves and pays for at least k - 1 changes, k if the best one is on it.
    """
    n, languages = scores.shape
    single = int(np.argmax(scores.sum(0)))
    gains = np.cumsum(scores - scores[:, [single]], axis=0)
    lowest = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(languages), gains[:-1]]), axis=0), 0)
    if (gains - lowest).max() <= switch / 2:
        return np.full(n, single)
    return viterbi(scores, switch)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The path by one step a word."""
    n, languages = scores.shape
    came = np.empty((n, languages), dtype=np.int16)
    rows = scores.tolist()
    value, every = rows[0], range(languages)
    came[0] = np.arange(languages)
    steps = []
    for row in rows[1:]:
        top = max(value)
        at, bar = value.index(top), top - switch
        steps.append([i if value[i] >= bar else at for i in every])
        value = [(v if v >= bar else bar) + s for v, s in zip(value, row)]
    if steps:
        came[1:] = steps
    path = np.empty(n, dtype=np.int64)
    path[-1] = value.index(max(value))
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


@dataclass
class Labelled:
    language: str
    score: float
    spans: list[dict] = field(default_factory=list)


def label(model: LanguageModel, texts: list[str | None], switch: float = SWITCH) -> Iterator[Labelled]:
    """For each text the language of most letters, their share, and spans of one language each, in code points.

    A span runs from the first letter of its first word to the last letter of its last. ``und``, 0 and no
    spans for texts that are null or without letters, and for every text where no language was learned.
    """
    for words, edges, begins in together([t or "" for t in texts]):
        scores = model.word_scores(words)
        ends = words.starts + words.sizes
        for first, last, begin in zip(edges[:-1], edges[1:], begins):
            if first == last or not model.languages:
                yield Labelled(UNKNOWN, 0.0)
                continue
            path = best_path(scores[first:last], switch)
            letters = np.bincount(path, weights=words.sizes[first:last], minlength=len(model.languages))
            a = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            b = np.r_[a[1:], len(path)] - 1
            starts, lengths = words.starts[first + a], ends[first + b] - words.starts[first + a]
            spans = [{"start": int(s - begin), "length": int(n), "lang": model.languages[x]} for s, n, x in zip(starts, lengths, path[a])]
            most = int(np.argmax(letters))
            yield Labelled(model.languages[most], float(letters[most] / letters.sum()), spans)


def _counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, n): counts of n-gram buckets and, below zero, of words by script."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                by_lang.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, texts in by_lang.items():
                mine = grams.setdefault(lang, np.zeros(len(LENGTHS) * BUCKETS, dtype=np.int64))
                seen = scripts.setdefault(lang, np.zeros(N_SCRIPTS, dtype=np.int64))
                for words, _, _ in together(texts):
                    seen += np.bincount(words.scripts, minlength=N_SCRIPTS)
                    often = np.bincount(words.same, minlength=len(words.distinct))
                    for some, sizes, letters in words.kinds(LETTERS_AT_ONCE):
                        for i, buckets, of in ngrams(sizes, letters):
                            # Counts are whole numbers below 2^53, exact as weights.
                            counted = np.bincount(buckets, weights=often[some][of], minlength=BUCKETS)
                            mine[i * BUCKETS : (i + 1) * BUCKETS] += counted.astype(np.int64)
        for lang, mine in grams.items():
            both = np.concatenate([scripts[lang][::-1], mine])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - N_SCRIPTS), pa.array(both[at])], ["lang", "kind", "n"])

    known = texts.where("lang is not null and text is not null")
    return known.mapInArrow(count, "lang string, kind long, n long").groupBy("lang", "kind").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all texts with a language; rows with a null text or language are left out.

    Counts are summed by bucket where the texts are and then over all tasks; the driver receives at most
    131,093 numbers per language, whatever the texts. Repeated rows count as often as they stand.
    """
    table = _counted(docs, text_col, lang_col).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    place = {lang: i for i, lang in enumerate(names)}
    of = np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    kind, n = table["kind"].to_numpy(), table["n"].to_numpy()
    counts = np.zeros((N_SCRIPTS + len(LENGTHS) * BUCKETS, len(names)))
    counts[kind + N_SCRIPTS, of] = n
    written, grams = counts[:N_SCRIPTS][::-1], counts[N_SCRIPTS:].reshape(len(LENGTHS), BUCKETS, -1)
    met = (grams.sum(2) > 0).sum(1)[:, None, None]
    scores = np.log(grams + PRIOR) - np.log(grams.sum(1, keepdims=True) + PRIOR * np.maximum(met, 1))
    allowed = written >= np.maximum(SCRIPT_SHARE * written.sum(0), 1)
    # A script that no language uses narrows nothing.
    allowed[~allowed.any(1)] = True
    return LanguageModel(names, np.ascontiguousarray(scores.reshape(len(LENGTHS) * BUCKETS, len(names)).T), allowed.T)


SPANS = "array<struct<start: long, length: long, lang: string>>"

_models: dict[str, LanguageModel] = {}


def labelled(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans, a row per row of ``docs``; see ``label``. Only the text counts, all of it."""
    name = uuid.uuid4().hex
    # At most 131,072 numbers and 21 flags per language, whatever the texts.
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])))])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                made = label(_models[name], some["text"].to_pylist(), switch)
                answers = pa.array([{"lang_pred": x.language, "score": x.score, "spans": x.spans} for x in made], kind)
                yield pa.RecordBatch.from_arrays([some["doc_id"], *answers.flatten()], ["doc_id", "lang_pred", "score", "spans"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans {SPANS}"
    return rows.mapInArrow(run, schema)
