import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def by_hand(words):
    return {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def neighbours(spark, words, **kw):
    rows = spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), **kw).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("letters, longest", [("ab", 48), ("abcé", 48), ("ab", 8)])
def test_neighbours_as_all_pairs_show(spark, letters, longest):
    rng = random.Random(len(letters) + longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(150)}
    words |= {w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in sorted(words) for i in [rng.randrange(len(w))]}
    want = by_hand(words)
    assert len(want) > 50
    assert neighbours(spark, words, longest=longest) == want


def test_edits_at_every_place(spark):
    word = "abcdefgh"
    near = {word[:i] + "x" + word[i + 1 :] for i in range(8)} | {word[:i] + word[i + 1 :] for i in range(8)} | {word[:i] + "x" + word[i:] for i in range(9)}
    words = near | {word}
    assert neighbours(spark, words) == by_hand(words)
    assert {p for p in by_hand(words) if word in p} and len({p for p in by_hand(words) if word in p}) == 25


def test_very_long_words(spark):
    words = {"a" * n for n in (7, 8, 47, 48, 49, 50, 52, 3000, 3001)} | {"a" * 40 + "b" + "a" * 8, "b" * 49, "a" * 3000 + "c", "a" * 1500 + "d" + "a" * 1500}
    assert neighbours(spark, words) == by_hand(words)


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    assert neighbours(spark, ["abcdefg"]) == set()


def whole_by_hand(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: set() for w in n}
    for a, b in by_hand(n):
        near[a].add(b), near[b].add(a)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_documents_as_read_by_hand(spark):
    rng = random.Random(3)
    base = ["received", "Straßennamen", "ÀÉcole×ab", "difference", "languages"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(40)) + " recieved receivd.receiving") for i in range(12)]
    # A chain of forms: a hundred, ten and one times as frequent.
    docs += [(100, "abcdefg " * 250), (101, "abcdefgh " * 24 + "bcdefgh " * 2 + "abcdefghi " * 2), (None, "received receivex receivex"), (7, None), (8, ""), (8, "")]
    want = whole_by_hand(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("word", "run", "n", "h", "id")})
    got = [tuple(r) for r in spelling.variants(spelling.counted(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got) == want
    assert any(form and root != form for _, form, root, *_ in want)
    assert sorted(tuple(r) for r in spelling.variants(spelling.counted(df.repartition(5))).select("word", "form", "root", "n", "n_near", "form_n").collect()) == want
    assert spelling.counted(df.limit(0)).count() == 0
