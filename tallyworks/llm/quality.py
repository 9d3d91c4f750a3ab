"""Text quality from learned subword vectors.

A text is the average of the vectors of its features: its words, the character n-grams in them
and a mark wherever a word repeats the one before. Features are hashed into a table of vectors,
which is learned together with a softmax layer by stochastic gradient descent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.supervised import fitted, labelled_sample

# Rows of a training sample: at most so many texts of good and of bad quality.
MAX_GOOD, MAX_BAD = 3000, 3000
BUCKETS, DIMENSIONS = 1 << 17, 16
NGRAMS = (3, 4)
EPOCHS, RATE, BATCH = 8, 0.5, 16
# The bucket of the mark for a repeated word; hashed features use the others.
REPEATED = 0
WORDS_REMEMBERED = 300_000
# Words hashed at a time, which bounds the memory for long texts.
WORDS_AT_ONCE = 1 << 15

_PRIME = np.uint64(0x100000001B3)


def _scattered(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(33))) % np.uint64(BUCKETS - 1) + np.uint64(1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, all words' in one array, and where each word's begin.

    A word is written between marks (``<word>``); its features are its n-grams of bytes and itself.
    """
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    room = ends[of] - np.arange(len(joined))
    buckets, owners = [], []
    h = np.zeros(len(joined), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        part = np.zeros(len(joined), dtype=np.uint64)
        part[: len(joined) - n + 1] = joined[n - 1 :]
        h = (h ^ part) * _PRIME + np.uint64(n)
        if n in NGRAMS:
            inside = np.flatnonzero(room >= n)
            buckets.append(_scattered(h[inside] + np.uint64(n)))
            owners.append(of[inside])
    # A word's own hash: the sum of its bytes' hashes by place.
    place = (np.arange(len(joined)) - starts[of]).astype(np.uint64)
    spread = (joined + np.uint64(257) * place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread = (spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    buckets.append(_scattered(np.add.reduceat(spread, starts)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(buckets)[order].astype(np.int64), np.cumsum(counts) - counts


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares of all its features; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(words), WORDS_AT_ONCE):
        counts += np.bincount(word_features(words[at : at + WORDS_AT_ONCE])[0], minlength=BUCKETS)
    counts[REPEATED] += sum(map(bytes.__eq__, words, words[1:]))
    found = np.flatnonzero(counts)
    return found, counts[found] / counts.sum()


@dataclass
class QualityModel:
    """``vectors`` of the buckets, ``layer`` (dimensions, 2) and ``bias`` of the softmax."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def probabilities(self, text: str | None) -> np.ndarray:
        found, shares = text_features(text)
        return _softmax(shares @ self.vectors[found] @ self.layer + self.bias)

    def scorer(self) -> Scorer:
        """The same answers from one number per bucket: of two classes only the difference counts."""
        away = self.layer[:, 1] - self.layer[:, 0]
        return Scorer((self.vectors @ away).astype(np.float32), float(self.bias[1] - self.bias[0]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    # Of every word met: its features' sum of weights and their number.
    known: dict[bytes, tuple[float, int]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str | None) -> float:
        """The probability of label 1; that of the bias for a text without words."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > WORDS_REMEMBERED:
            self.known.clear()
            new = list(set(words))
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            buckets, starts = word_features(part)
            sums = np.add.reduceat(self.weights[buckets].astype(np.float64), starts)
            counts = np.diff(np.append(starts, len(buckets)))
            self.known.update(zip(part, zip(sums.tolist(), counts.tolist())))
        hits = np.array([self.known[w] for w in words])
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        total, count = hits.sum(0) + (repeats * float(self.weights[REPEATED]), repeats)
        return float(1 / (1 + np.exp(-np.clip(total / count + self.bias, -30, 30))))


def fit_quality(texts: Iterable[str], labels: Iterable[int], seed: int = 0) -> QualityModel:
    """Vectors and softmax layer by stochastic gradient descent over the texts, the rate falling to zero.

    Without texts every class is as likely.
    """
    rng = np.random.default_rng(seed)
    rows = [(*text_features(t), int(y)) for t, y in zip(texts, labels)]
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - (epoch * len(order) + at) / (EPOCHS * len(order)))
            batch = [rows[i] for i in order[at : at + BATCH]]
            means = np.stack([shares @ vectors[found] for found, shares, _ in batch])
            wrong = _softmax(means @ layer + bias)
            wrong[np.arange(len(batch)), [y for _, _, y in batch]] -= 1
            back = wrong @ layer.T
            layer -= rate * means.T @ wrong
            bias -= rate * 0.1 * wrong.sum(0)
            for (found, shares, _), g in zip(batch, back):
                # A text's features share its gradient; scaled by their number, as summed vectors would be.
                vectors[found] -= np.outer(shares * (rate * VECTOR_RATE), g)
    return QualityModel(vectors.astype(np.float32), layer, bias)


# Averages make the gradient of one vector small; this makes up for it.
VECTOR_RATE = 50.0


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_good: int = MAX_GOOD,
    max_bad: int = MAX_BAD,
) -> QualityModel:
    """A model fitted on at most ``max_good`` and ``max_bad`` labelled texts, drawn by a hash of their id.

    ``labels`` has doc_id and ``label_col`` of 0 and 1. Rows with a null id or label are left out.
    """
    sample = labelled_sample(docs, labels, [label_col], {1: max_good, 0: max_bad}, id_col=id_col, text_col=text_col)

    def fit(rows: pd.DataFrame) -> tuple:
        model = fit_quality(rows["text"], rows[label_col])
        return model.vectors, model.layer, model.bias

    return QualityModel(*fitted(sample, fit))


_scorers: dict[str, Scorer] = {}


def _scorer(of: str, weights: np.ndarray, bias: float) -> Scorer:
    """The worker's scorer of a model, kept with the words it has met."""
    if of not in _scorers:
        _scorers.clear()
        _scorers[of] = Scorer(weights, bias)
    return _scorers[of]


def scored(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``score``, the probability of label 1, a row per row of ``docs``.

    The whole text counts, and nothing but the text. Null and empty texts score what the bias says.
    """
    scorer = model.scorer()
    # One number per bucket, as large for any table.
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        scorer = _scorer(name, *sent.value)
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{text_col}`").cast("string")).alias("score"))
