import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import quality, supervised, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    held_out = supervised.id_crc() % 4 == 2
    model = quality.train(docs, labels.where(~held_out))
    rows = quality.scored(docs, model).join(labels, "doc_id").where(held_out).collect()
    assert len(rows) > 50
    right = [(r.score >= 0.7) == (r.quality == 1) for r in rows]
    assert np.mean(right) >= 0.97
    assert {r.score for r in rows if not 0 <= r.score <= 1} == set()


def test_one_number_per_bucket_gives_the_same_scores():
    texts = ["good words in a row", "bad bad bad bad", "", "Ünï!! code!!", "x" * 5000, "w " * 70_000]
    model = quality.fit_quality(texts[:2] * 4, [1, 0] * 4)
    scorer = model.scorer()
    for t in [*texts, None]:
        assert scorer.score(t) == pytest.approx(float(model.probabilities(t)[1]), abs=1e-5)
    assert scorer.score(texts[0]) > 0.5 > scorer.score(texts[1])


def test_a_word_repeated_has_a_mark():
    found, shares = quality.text_features("a a a b")
    assert dict(zip(found, shares))[quality.REPEATED] > 0
    assert quality.REPEATED not in quality.text_features("a b a b")[0]


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0), (3, 0), (1, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def test_toxicity_on_labels_not_seen(spark):
    """Over all toxic rows of a table with labels enough, in every language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = supervised.id_crc() % 4 == 2
    chain = toxicity.train(docs, toxicity.by_language(labels, docs).where(~fold), toxicity.CATEGORIES)
    rows = toxicity.scored(docs, chain).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(fold).collect()
    said = [(r.toxic, r.lang, max(r.p_toxic_en, r.p_toxic_other, r.p_toxic) >= 0.5) for r in rows]
    assert np.mean([s for toxic, _, s in said if toxic]) >= 0.85
    for lang in ("de", "en", "es", "fr"):
        assert np.mean([s for toxic, x, s in said if toxic and x == lang]) >= 0.75
    assert np.mean([not toxic for toxic, _, s in said if s]) <= 0.02


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 400)
    texts = [("bad " if f else "fine ") + f"word{i}" for i, f in enumerate(first)]
    labels = np.stack([first, first], axis=1).astype(float)
    chain = toxicity.fit_chain(texts, labels, ["one", "two"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][len(chain.features)] > 0
    high, low = chain.probabilities("bad"), chain.probabilities("fine")
    assert min(high) > 0.5 > max(low)


def test_logistic_agrees_with_its_optimum():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 3)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] - 0.3)))).astype(float)
    row, column = np.nonzero(x[:, :2])
    seen = toxicity.Seen(row, column, 2, x[:, 2:])
    w = toxicity.logistic(seen, y)
    assert np.allclose(seen.times(w[:-1]), x @ w[:-1])
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert abs((p - y).mean()) < 1e-3 and np.abs(x.T @ (p - y) / len(y)).max() < 5e-3
    half = np.arange(500) % 2 == 0
    assert np.allclose(seen.of(half).times(w[:-1]), x[half] @ w[:-1])


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you fool", "en", 1), (None, None, None, 2), (3, "", "en", 3), (3, "", "en", 3)], "doc_id long, text string, lang string, p int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, toxicity.by_language(labels, docs), toxicity.CATEGORIES)
    assert toxicity.scored(docs, chain).count() == 4
    none = toxicity.train(docs, toxicity.by_language(labels.limit(0), docs), toxicity.CATEGORIES)
    kept = toxicity.without_toxic(docs, none, threshold=0.6)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.without_toxic(docs.limit(0), chain).count() == 0


def test_samples_are_bounded_and_repeatable(spark, tables):
    docs, labels = tables
    draw = lambda: sorted(supervised.labelled_sample(docs, labels, ["quality"], {1: 20, 0: 10}).select("key", "quality").collect())
    one = draw()
    assert one == draw() and [sum(r.quality == k for r in one) for k in (1, 0)] == [20, 10]
    assert supervised.labelled_sample(docs, labels.where(F.lit(False)), ["quality"], {1: 1}).count() == 0
