from collections import Counter

from pyspark.sql import functions as F

from tallyworks.llm import common, mixing, rules


def test_ledger_of_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, " \n\t"), (3, "a b c a b c"), (3, "a b c a b c"), (None, "x\nx\n\nx \ny"), (4, "É é!! ** | 𝒳"), (5, "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = [r.asDict() for r in rules.ledger(docs).collect()]
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[3, 6]["n_repeat_words"] == 6 and by[3, 6]["n_twice"] == 0
    assert by[None, 4]["n_dup_lines"] == 1 and by[None, 4]["n_lines"] == 4
    four = by[4, 5]
    assert (four["word_chars"], four["n_symbols"], four["n_capitals"]) == (8, 3, 2)
    assert by[5, 20_000]["n_repeat_words"] == 20_000 and by[5, 20_000]["n_twice"] == 19_999
    assert all(v == 0 for k, v in by[1, 0].items() if k in rules.MEASURES)
    assert rules.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations_read_the_bits_alone(spark):
    failed = [0, 0, 1, 1, 2, 3, 4, 5, 1 << 40]
    ledger = spark.createDataFrame([(i, f) for i, f in enumerate(failed)], "doc_id int, failed long")
    for version in rules.POLICIES:
        mask = rules.mask(version)
        kept = {r.doc_id for r in rules.verdicts(ledger, version).where("kept").collect()}
        assert kept == {i for i, f in enumerate(failed) if not f & mask}
        got = {r.rule: (r.n_failed, r.n_kept_without, r.n_only) for r in rules.ablation(ledger, version).collect()}
        want = {}
        for r in rules.RULES:
            if r.name in rules.POLICIES[version]:
                b = 1 << r.bit
                without = sum(not f & mask & ~b for f in failed)
                want[r.name] = (sum(bool(f & b) for f in failed), without, sum(bool(f & b) and not f & mask & ~b for f in failed))
        assert got == want
    assert {(r.n_failed, r.n_kept_without, r.n_only) for r in rules.ablation(ledger.limit(0), 2).collect()} == {(0, 0, 0)}


def filled(sizes, weights, budget, cap):
    """Targets by handing out the rest again and again."""
    target, left, open_ = [0.0] * len(sizes), budget, set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if cap * sizes[i] <= left * weights[i] / w}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_water_filling(spark):
    for sizes, weights, budget, cap in (([100, 10, 1, 50], [1, 2, 3, 1], 161, 3.0), ([5, 5], [1, 1], 100, 3.0), ([0, 4], [5, 1], 4, 2.0), ([7], [2], 7, 1.0)):
        frame = spark.createDataFrame([(str(i), s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, size long, weight double")
        got = {r.source: r.target for r in mixing.filled(frame, budget, cap).collect()}
        want = filled(sizes, weights, budget, cap)
        assert all(abs(got[str(i)] - t) < 1e-9 for i, t in enumerate(want))


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [mixing.taken(mixing.mixture(docs.repartition(n))).select(F.col("_row.doc_id").alias("d"), "source", "size", "target", "copies").collect() for n in (3, 7)]
    assert sorted(runs[0]) == sorted(runs[1])
    taken, target, longest = Counter(), {}, Counter()
    for r in runs[0]:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    other = mixing.taken(mixing.mixture(docs, seed=1)).select(F.col("_row.doc_id").alias("d"), "copies").collect()
    assert {(r.d, r.copies) for r in other} != {(r.d, r.copies) for r in runs[0]}


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", "s", 1), (1, "a b", "s", 1), (None, None, "s", 2), (2, "", None, 3), (3, "c d e", None, 4), (4, "f", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.taken(mixing.mixture(docs)).collect()
    assert len(plan) == 6 and len({r.copies for r in plan if r._row.doc_id == 1}) == 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    only = spark.createDataFrame([("t", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mixed(docs, only).collect()} <= {"t"}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_numbers_are_places_in_order(spark):
    values = [5, 3, 3, None, 8, 1]
    frame = spark.createDataFrame([(v,) for v in values], "v int").repartition(4)
    rows = common.numbered(frame, F.col("v").asc_nulls_last()).collect()
    assert sorted(r.rank for r in rows) == list(range(6))
    assert [r.v for r in sorted(rows, key=lambda r: r.rank)] == [1, 3, 3, 5, 8, None]
