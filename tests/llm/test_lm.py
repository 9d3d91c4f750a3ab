import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import lm, supervised

FIELDS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def sequence(text):
    return b" ".join(lm.tokens(text)) + lm.END


def slow_model(sequences, depth):
    """Log10 probability of any sequence by context-tree weighting over its bytes, by plain recursion."""
    nodes = {}
    for s in sequences:
        x = lm.END * depth + s
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                p = 1
                for j in range(7, -1, -1):
                    bit = x[i] >> j & 1
                    nodes.setdefault((x[i - d : i], p), [0, 0])[bit] += 1
                    p = p * 2 + bit
    children = {}
    for c, p in nodes:
        if c:
            children.setdefault((c[1:], p), []).append((c, p))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight = {}

    def whole(node):
        own = kt(*nodes[node])
        if len(node[0]) == depth:
            weight[node] = 1.0
            return own
        both = np.logaddexp(own, sum(map(whole, children[node]))) + math.log(0.5)
        weight[node] = math.exp(own + math.log(0.5) - both)
        return both

    for node in nodes:
        if not node[0]:
            whole(node)

    def one(path, p):
        """Chance of a one: each context's own estimate by its weight, the rest by the next longer that was seen."""
        out, left = 0.0, 1.0
        on = [(c, p) for c in path if (c, p) in nodes]
        if not on:
            return 0.5
        for k, node in enumerate(on):
            a, b = nodes[node]
            share = 1.0 if k == len(on) - 1 else weight[node]
            out += left * share * (b + 0.5) / (a + b + 1)
            left *= 1 - share
        return out

    def logprob(s):
        x, total = lm.END * depth + s, 0.0
        for i in range(depth, len(x)):
            path, p = [x[i - d : i] for d in range(depth + 1)], 1
            for j in range(7, -1, -1):
                bit = x[i] >> j & 1
                chance = one(path, p)
                total += math.log10(chance if bit else 1 - chance)
                p = p * 2 + bit
        return total

    return logprob


def by_hand(rows, depth=lm.DEPTH):
    """(id, tokens, known, training tokens, base score, score) of (id, text, trained) rows."""
    trained = Counter(x for _, t, learns in rows if learns for x in [*lm.tokens(t), lm.END])
    n, v = sum(trained.values()), len(trained)
    logprob = slow_model([sequence(t) for _, t, learns in rows if learns], depth)
    out = []
    for i, t, _ in rows:
        words = [*lm.tokens(t), lm.END]
        base = sum(math.log10((trained[x] + 1) / (n + v + 1)) for x in words)
        out.append((i, len(words), sum(trained[x] > 0 for x in words), n, base, logprob(sequence(t))))
    return sorted(out, key=str)


def scores(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, learns) for i, t, learns in rows], "doc_id long, text string, learns boolean").repartition(parts)
    return sorted(((r.doc_id, *(r[c] for c in FIELDS)) for r in lm.scored(docs, F.col("learns")).collect()), key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.5, 40.0, 1e7])
    assert np.allclose(lm._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


ODD = [(None, None), (9001, ""), (9002, "the the"), (9002, "the the"), (9003, "zz\x00q qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq É"), (9004, " \n\t "), (9005, "THE Ünï � 日本")]


def test_scores_equal_plain_recursion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").limit(30).collect()
    rows = [(r.doc_id, r.text) for r in docs] + ODD
    rows = [(i, t, zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2) for i, t in rows]
    assert 2 <= sum(not learns for *_, learns in rows) < 15
    same(scores(spark, rows), by_hand(rows))


def test_blocks_pieces_and_tasks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcd"), 3)) for _ in range(20)]
    rows = [(i, " ".join(stems[k] + stems[-k] for k in rng.integers(0, 20, rng.integers(0, 60))), i % 3 > 0) for i in range(40)]
    want = by_hand(rows)
    same(scores(spark, rows, 1), want)
    monkeypatch.setattr(lm, "BLOCK", 64)
    monkeypatch.setattr(lm, "AT_ONCE", 64)
    same(scores(spark, rows, 6), want)


def test_pieces_put_together_are_the_sequence():
    for text in ("", "a", "ab cd " * 50, "x" * 300, "a " + "y" * 100 + " b"):
        s = sequence(text)
        for size in (1, 7, 64, 10_000):
            cut = list(lm.pieces(s, size))
            assert b"".join(own for _, own in cut) == s
            seen = lm.END * lm.DEPTH
            for before, own in cut:
                assert before == seen[-lm.DEPTH :] and own.endswith((b" ", lm.END))
                seen += own


def test_words_of_a_block():
    texts = ["the cat", "", "the", "cat the cat"]
    sequences = [sequence(t) for t in texts]
    buffer = b"".join(lm.END * lm.DEPTH + s for s in sequences)
    words, piece = lm.Block(np.frombuffer(buffer, dtype=np.uint8), np.array([len(s) for s in sequences])).words()
    names = [[*t.split(), None] for t in texts]
    assert piece.tolist() == [k for k, x in enumerate(names) for _ in x]
    flat = [w for x in names for w in x]
    assert all((words[i] == words[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_bytes_after_a_context_sum_to_one():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.choice(np.frombuffer(b"abcd \n", dtype=np.uint8), (400, lm.DEPTH + 1)).astype(np.uint64) @ (np.uint64(1) << np.arange(0, 8 * lm.DEPTH + 1, 8, dtype=np.uint64)))
    levels = lm.grown(grams, rng.integers(0, 9, len(grams)))
    context = grams[7] >> np.uint64(8)
    every = context << np.uint64(8) | np.arange(256, dtype=np.uint64)
    keys = np.unique(lm.shorter(lm.decisions(every)[0].ravel(), lm.DEPTH - lm.LOW + 1))
    half = np.full(len(keys), 0.5)
    states = {"key": keys, "said": 0.2 * half, "left": np.full(len(keys), 0.8), "visited": np.ones(len(keys), dtype=bool), "stop": half, "one": half}
    assert (10 ** lm.costs(every, levels, states)).sum() == pytest.approx(1.0)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = supervised.id_crc() % 7 == 2
    total = lm.scored(docs, ~held_out).where(held_out).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.b < 0 and total.s > 0.98 * total.b


def test_order_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    text = docs.where("n_chars between 1500 and 3000").first().text
    words = text.split()
    shuffled = " ".join(np.random.default_rng(1).permutation(words))
    rows = [(r.doc_id, r.text, True) for r in docs.select("doc_id", "text").collect()] + [(-1, " ".join(words), False), (-2, shuffled, False)]
    got = {r[0]: r for r in scores(spark, rows)}
    assert got[-1][4] == pytest.approx(got[-2][4])
    assert got[-1][5] > got[-2][5]


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 1 << 16)
    rows = [(1, "all work and no play " * 20_000, True), (2, "x" * 200_000, True), (3, "all work and play", False)]
    got = {r[0]: r for r in scores(spark, rows)}
    assert got[1][1] == 100_001 and got[2][1] == 2 and got[1][3] == 100_003
    assert -2000 < got[1][5] < 0 and -400 < got[2][5] < 0 and math.isfinite(got[3][5])


def test_no_training_texts_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2)], "doc_id long, text string, block int").withColumns({c: F.lit("z") for c in ("uid", "trained", "id", "key", "parts")})
    got = {r.doc_id: r for r in lm.scored(docs, F.lit(False)).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].score == pytest.approx(4 * 8 * math.log10(0.5))
    assert got[2].n_tokens == 1 and got[2].score == pytest.approx(8 * math.log10(0.5))
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0
    assert lm.scored(docs, F.lit(None).cast("boolean")).count() == 2
