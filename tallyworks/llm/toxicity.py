"""Toxicity by a classifier chain: linear models in a row, each told what the ones before it found.

A model sees which words and word beginnings a text has, and the log-odds of the earlier
categories. While training these come from models that have not seen the text (out of fold), so
that a later model learns how far an earlier one can be trusted on new texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.supervised import fitted, labelled_sample

# Rows of a training sample: at most so many texts with some category set, and without any.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
# Features kept, those that tell most about some category: found in at least so many texts, and so
# unevenly by chi-squared that among many rare words few come so far by chance.
FEATURES, IN_TEXTS, LEAST_CHI2 = 1024, 3, 30.0
PREFIXES = (4, 5, 6)
FOLDS = 3
STEPS, PENALTY = 120, 1e-3
LOG_ODDS_WITHIN = 8.0
# Distinct words whose features a worker remembers before it starts afresh.
WORDS_REMEMBERED = 150_000

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> set[str]:
    """The words in a token in lower case, and their beginnings."""
    out = set()
    for word in _LETTERS.findall(token.lower()):
        out.add("=" + word)
        out.update(word[:n] for n in PREFIXES if len(word) >= n)
    return out


@dataclass
class Chain:
    """``weights``: per category those of the features, then of the earlier categories, then the bias."""

    categories: tuple[str, ...]
    features: dict[str, int]
    weights: list[np.ndarray]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def found_in(self, text: str | None) -> list[int]:
        """The features that a whole text has, each once."""
        tokens, found = set((text or "").split()), set()
        if len(self.known) > WORDS_REMEMBERED:
            self.known.clear()
        for t in tokens:
            hits = self.known.get(t)
            if hits is None:
                hits = self.known[t] = tuple(self.features[f] for f in features_of(t) if f in self.features)
            found.update(hits)
        return sorted(found)

    def probabilities(self, text: str | None) -> list[float]:
        """Of each category in turn. A text without words has none of the features."""
        found, odds, n = self.found_in(text), [], len(self.features)
        for w in self.weights:
            z = w[-1] + w[found].sum() + sum(w[n + i] * o for i, o in enumerate(odds))
            odds.append(float(np.clip(z, -LOG_ODDS_WITHIN, LOG_ODDS_WITHIN)))
        return [float(1 / (1 + np.exp(-o))) for o in odds]


@dataclass
class Seen:
    """What models see of texts: the places (``row``, ``column``) of ones, and further ``dense`` columns."""

    row: np.ndarray
    column: np.ndarray
    n_columns: int
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def of(self, rows: np.ndarray) -> Seen:
        """The texts for which ``rows`` is true."""
        keep, at = rows[self.row], np.cumsum(rows) - 1
        return Seen(at[self.row[keep]], self.column[keep], self.n_columns, self.dense[rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.bincount(self.row, w[self.column], minlength=len(self))
        return sums + self.dense @ w[self.n_columns :]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.append(np.bincount(self.column, r[self.row], minlength=self.n_columns), self.dense.T @ r)


def logistic(x: Seen, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a penalised logistic regression, by accelerated gradient steps.

    Columns are scaled by how often they are set, so that rare ones move as fast as common ones.
    Of a single class, the bias alone says so.
    """
    n, width = len(x), x.n_columns + x.dense.shape[1]
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(width + 1)
    w[-1] = np.clip(np.log(rate / (1 - rate)), -LOG_ODDS_WITHIN, LOG_ODDS_WITHIN)
    if len(np.unique(y)) < 2 or not width:
        return w
    squares = np.append(np.bincount(x.column, minlength=x.n_columns), np.square(x.dense).sum(0)) / n
    scale = np.append(1 / np.sqrt(np.maximum(squares, 1e-6)), 1.0)
    forth = lambda v: x.times(v[:-1] * scale[:-1]) + v[-1]
    back = lambda r: np.append(x.back(r) * scale[:-1], r.sum())
    penalty = np.append(np.full(width, PENALTY), 0.0)
    v = np.random.default_rng(0).normal(size=width + 1)
    for _ in range(20):
        v = back(forth(v / np.linalg.norm(v)))
    step = 1 / (0.3 * np.linalg.norm(v) / n + PENALTY)
    at = ahead = w
    for k in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(forth(ahead), -30, 30)))
        nxt = ahead - step * (back(p - y) / n + penalty * ahead)
        ahead = nxt + (k - 1) / (k + 2) * (nxt - at)
        at = nxt
    return at * scale


def _informative(texts: list[str], labels: np.ndarray) -> list[str]:
    """The features that tell most about some category, by chi-squared.

    A token counts where it stands between other neighbours than in the texts before: copies of a
    text would make all its words look telling.
    """
    n, totals = len(texts), labels.sum(0)
    met: set[int] = set()
    seen: Counter[str] = Counter()
    with_label: list[Counter[str]] = [Counter() for _ in totals]
    for text, row in zip(texts, labels):
        tokens = ["", *text.split(), ""]
        fresh = {k: token for before, token, after in zip(tokens, tokens[1:], tokens[2:]) if (k := hash((before, token, after))) not in met}
        met.update(fresh)
        found = set().union(*map(features_of, set(fresh.values())))
        seen.update(found)
        for counts, label in zip(with_label, row):
            if label:
                counts.update(found)
    kept = sorted(f for f, c in seen.items() if IN_TEXTS <= c < n)
    count = np.array([seen[f] for f in kept], dtype=float)[:, None]
    labelled = np.array([[counts[f] for counts in with_label] for f in kept], dtype=float).reshape(len(kept), len(totals))
    expected = count * totals / max(n, 1)
    spread = np.maximum(expected * (1 - count / max(n, 1)) * (1 - totals / max(n, 1)), 1e-9)
    score = (np.square(labelled - expected) / spread).max(1, initial=0)
    best = np.lexsort((np.arange(len(kept)), -score))[:FEATURES]
    return [kept[i] for i in sorted(best) if score[i] >= LEAST_CHI2]


def fit_chain(texts: list[str], labels: np.ndarray, categories: list[str]) -> Chain:
    """A chain over ``categories`` in their order; row k of ``labels`` says which of them text k has."""
    features = {f: i for i, f in enumerate(_informative(texts, labels))}
    chain = Chain(tuple(categories), features, [])
    found = [chain.found_in(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found]).astype(np.int64)
    column = np.array([i for f in found for i in f], dtype=np.int64)
    fold = np.arange(len(texts)) % FOLDS
    earlier = np.zeros((len(texts), 0))
    for c in range(len(categories)):
        seen, y = Seen(row, column, len(features), earlier), labels[:, c].astype(float)
        odds = np.zeros(len(texts))
        for k in range(FOLDS):
            w = logistic(seen.of(fold != k), y[fold != k])
            odds[fold == k] = seen.of(fold == k).times(w[:-1]) + w[-1]
        chain.weights.append(logistic(seen, y))
        earlier = np.hstack([earlier, np.clip(odds, -LOG_ODDS_WITHIN, LOG_ODDS_WITHIN)[:, None]])
    return chain


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
) -> Chain:
    """A chain fitted on at most ``max_toxic`` and ``max_clean`` labelled texts, drawn by a hash of their id.

    ``labels`` has doc_id and a column of 0 and 1 per category. Rows with a null id or label are left
    out. Without labels, or with those of one class only, the chain repeats the share it has seen.
    """
    sample = labelled_sample(docs, labels, categories, {1: max_toxic, 0: max_clean}, id_col=id_col, text_col=text_col)

    def fit(rows: pd.DataFrame) -> tuple:
        chain = fit_chain(list(rows["text"]), rows[categories].to_numpy(dtype=float), categories)
        return chain.features, chain.weights

    return Chain(tuple(categories), *fitted(sample, fit))


def _scores(text: Column, chain: Chain) -> Column:
    # Rows go to Python 100 at a time, so neither side holds thousands of whole texts.
    @F.udf("array<double>", useArrow=False)
    def of(text: str | None) -> list[float]:
        return chain.probabilities(text)

    return of(text)


def scored(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of each category as ``p_<category>``, a row per row of ``docs``.

    Every word of a text is looked at. Null and empty texts are scored by the bias. Other columns
    are left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _scores(F.col(f"`{text_col}`").cast("string"), chain).alias("p"))
    return rows.select("doc_id", *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(chain.categories)])


def without_toxic(docs: DataFrame, chain: Chain, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` none of whose categories reaches ``threshold``, with all their columns."""
    likely = F.array_max(_scores(F.col(f"`{text_col}`").cast("string"), chain))
    return docs.where(likely < threshold)


def by_language(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, toxic_en, toxic_other, toxic: a table's one toxicity label, told apart by language."""
    langs = docs.select("doc_id", "lang").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    toxic, english = F.col("toxic").cast("int"), F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int")
    return labels.join(langs, "doc_id").select(
        "doc_id", (toxic * english).alias("toxic_en"), (toxic * (1 - english)).alias("toxic_other"), toxic.alias("toxic")
    )


CATEGORIES = ["toxic_en", "toxic_other", "toxic"]
