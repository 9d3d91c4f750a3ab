import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import languages, supervised

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string"


def best_by_steps(scores, switch):
    """The textbook recurrence: every language to every language."""
    n, k = scores.shape
    value = scores[0].copy()
    for t in range(1, n):
        value = np.array([max(value[j] - (switch if i != j else 0) for j in range(k)) + scores[t, i] for i in range(k)])
    return value.max()


def worth(path, scores, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (path[1:] != path[:-1]).sum()


@pytest.mark.parametrize("scale", [0.1, 1, 3, 10])
def test_paths_are_the_best(scale):
    rng = np.random.default_rng(7)
    for _ in range(60):
        scores = rng.normal(0, scale, (rng.integers(1, 40), rng.integers(1, 5)))
        want = best_by_steps(scores, 8.0)
        for path in (languages.best_path(scores, 8.0), languages.viterbi(scores, 8.0)):
            assert worth(path, scores, 8.0) == pytest.approx(want)


def by_hand(model, word):
    """A word's scores, an n-gram at a time."""
    letters = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    marked, mask = [0, *letters, 1], (1 << 64) - 1
    out = np.zeros(len(model.languages))
    for i, n in enumerate(languages.LENGTHS):
        for at in range(len(marked) - n + 1):
            gram = marked[at : at + n]
            if n == 1 and at in (0, len(marked) - 1):
                continue
            h = 0
            for c in gram:
                h = ((h ^ c) * int(languages.MIX)) & mask
                h ^= h >> 31
            out += model.scores[:, i * languages.BUCKETS + (h >> 13) % languages.BUCKETS] / len(languages.LENGTHS)
    return out


def test_scores_of_words_one_at_a_time(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der Hund schläft", "de"), (3, "кот спит", "ru")], SCHEMA)
    model = languages.train(docs)
    assert model.languages == ["de", "en", "ru"]
    text = "The schläft, the, ÄB-x " + "long" * 50
    words = languages.words_of(text)
    got = model.word_scores(words)
    spoken = ["The", "schläft", "the", "ÄB", "x", "long" * 50]
    assert [text[s : s + n] for s, n in zip(words.starts, words.sizes)] == spoken
    for word, row in zip(spoken, got):
        want = by_hand(model, word) + np.array([0, 0, languages.EXCLUDED])
        assert row == pytest.approx(want)


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = supervised.id_crc() % 4 == 2
    rows = languages.labelled(docs, languages.train(docs.where(~held_out))).where(held_out).join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 2000 and all(0 <= r.score <= 1 for r in rows)
    for lang in {r.lang for r in rows}:
        assert np.mean([r.lang_pred == lang for r in rows if r.lang == lang]) >= 0.98


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(docs)
    en, de = (max((r.text for r in docs.where(f"lang = '{x}' and n_chars between 2000 and 4000").select("text").collect()), key=len) for x in ("en", "de"))
    mixed = en + "\n\n" + de
    got = next(languages.label(model, [mixed]))
    assert [s["lang"] for s in got.spans] == ["en", "de"]
    assert abs(got.spans[1]["start"] - len(en) - 2) < 60
    assert got.spans[0]["start"] >= 0 and got.spans[1]["start"] + got.spans[1]["length"] <= len(mixed)
    assert got.language == ("en" if sum(map(str.isalpha, en)) > sum(map(str.isalpha, de)) else "de")


def test_scripts_narrow(spark):
    docs = spark.createDataFrame([(1, "καλημέρα κόσμε", "el"), (2, "привет мир", "ru"), (3, "доброго ранку світ", "uk"), (4, "hello world", "en")], SCHEMA)
    model = languages.train(docs)
    said = [x.language for x in languages.label(model, ["κόσμε", "мир", "ранку", "world", "世界", "κόσμε мир κόσμε κόσμε"])]
    assert said[:4] == ["el", "ru", "uk", "en"] and said[4] in model.languages and said[5] == "el"
    spans = next(languages.label(model, ["κόσμε κόσμε hello world"])).spans
    assert spans == [{"start": 0, "length": 11, "lang": "el"}, {"start": 12, "length": 11, "lang": "en"}]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat", "en"), (1, "the cat", "en"), (None, "der Hund", "de"), (3, None, "en"), (4, "", "en"), (5, "12 !? 3", "de"), (6, "x", None), (7, "\U0001d573 a" * 3, "en")], SCHEMA
    ).withColumns({c: F.lit(1) for c in ("spans", "score", "kind", "n")})
    model = languages.train(docs)
    rows = languages.labelled(docs, model).collect()
    assert len(rows) == 8
    got = {(r.doc_id): (r.lang_pred, r.score) for r in rows}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1] == ("en", 1.0) and got[None] == ("de", 1.0) and got[6][0] in ("de", "en")
    assert languages.labelled(docs.limit(0), model).count() == 0
    none = languages.train(docs.limit(0))
    assert {r.lang_pred for r in languages.labelled(docs, none).collect()} == {"und"}


def test_a_very_long_text_and_a_very_long_word(spark):
    model = languages.train(spark.createDataFrame([(1, "the cat sat", "en"), (2, "der Hund lief", "de")], SCHEMA))
    long = "der Hund " * 300_000
    got = list(languages.label(model, [long, "the " + "cat" * 500_000, "the"]))
    assert [g.language for g in got] == ["de", "en", "en"]
    assert got[0].spans == [{"start": 0, "length": len(long) - 1, "lang": "de"}]
    # Scores do not depend on how the words are dealt into slices.
    words = languages.words_of("the cat sat on der Hund " * 20)
    whole = model.word_scores(words)
    before, languages.LETTERS_AT_ONCE = languages.LETTERS_AT_ONCE, 5
    try:
        assert model.word_scores(words) == pytest.approx(whole)
    finally:
        languages.LETTERS_AT_ONCE = before
