import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import sketches

PARAGRAPH = re.compile(sketches.PARAGRAPH)


def likeness(a, b):
    x, y = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), round(likeness(t, edit), 9), round(likeness(t, nxt), 9)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("rows_a_block", [7, 1024])
def test_compared_equals_brute_force_on_the_whole_table(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", rows_a_block)
    if rows_a_block == 7:
        monkeypatch.setattr(sketches, "CELLS", 16)  # for retries
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    result = sketches.compared(docs).cache()
    assert got(result) == expected([(r.doc_id, r.text) for r in docs.collect()])
    prints = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in result.collect():
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert max(r.retries for r in result.collect()) >= (rows_a_block == 7)


def test_odd_rows(spark):
    rows = [(3, "A b. C d.\nE f.", "x"), (None, None, None), (2, "", "x"), (1, "é. " * 40, "x"), (1, "é. " * 40, "x"), (9, "\n", "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    assert got(sketches.compared(docs)) == expected([r[:2] for r in rows])
    one = spark.createDataFrame([(1, "Only one. Here.")], "doc_id long, text string")
    assert got(sketches.compared(one)) == expected([(1, "Only one. Here.")])
    assert sketches.compared(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "x z")], "doc_id string, text string")
    assert sketches.compared(named).count() == 2


def test_peeling_recovers_what_differs_and_says_if_it_cannot(spark):
    sides = [(1, [i for i in range(100, 130)], 1), (1, [i for i in range(110, 133)], -1)]
    rows = spark.createDataFrame(sides, "block int, of array<long>, sign long")
    for cells, whole in ((256, True), (2, False)):
        held = sketches.sketch(rows, ["block", "sign"], "of", cells)
        differences = held.groupBy("block", "cell").agg(
            F.sum(F.col("held") * F.col("sign")).alias("held"), F.bit_xor("digests").alias("digests"), F.bit_xor("checks").alias("checks")
        )
        left = sketches.peeled(differences, ["block"], cells).collect()
        assert all(r.found is not None for r in left) == whole
        if whole:
            assert {(r.found, r.held) for r in left} == {(i, 1) for i in range(100, 110)} | {(i, -1) for i in range(130, 133)}


def test_sketches_take_one_shuffle_of_the_digests(spark):
    rows = spark.createDataFrame([(0, 1, False, [1, 2], [3])], "block int, pos int, ghost boolean, own array<long>, edit array<long>")
    plan = sketches.peeled(sketches._subtracted(rows, 16, True, 3), sketches.PAIR, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
