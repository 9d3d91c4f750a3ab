from pyspark.sql import functions as F

from tallyworks.llm import common, lines


def test_a_long_passage_goes_from_all_but_its_first_document(spark):
    passage = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(3)]
    rows = [(k, "\n".join([f"own {k} a", *passage, f"own {k} b"])) for k in (4, 2, 9, 7)]
    rows.append((11, "\n".join(passage[:2])))  # 40 words are too few
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == dict(rows)[2] and got[11] == dict(rows)[11]
    assert all(got[k] == f"own {k} a\nown {k} b" for k in (4, 7, 9))


def test_odd_rows(spark):
    long = "\n".join(f"line {i} " + "x " * 30 for i in range(4))
    rows = [(None, long, "a"), (None, None, "b"), (1, "", "c"), (2, long, "d"), (2, long, "d"), (3, long + "\n" + long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({c: F.lit(0) for c in ("runs", "kept", "least", "content", "first", "_n")})
    got = sorted(((r.doc_id, r.text, r.key) for r in lines.deduplicated(docs).collect()), key=str)
    # Rows of the same id and text are one document and keep the same.
    want = [(None, "", "a"), (None, None, "b"), (1, "", "c"), (2, long, "d"), (2, long, "d"), (3, "", "e")]
    assert got == sorted(want, key=str)
    assert lines.deduplicated(docs.limit(0)).count() == 0
    assert lines.windows(docs.where(F.lit(False))).count() == 0


def maximal_runs(rows, min_words):
    """Texts without the lines of any run of at least ``min_words`` words that stands earlier already, tried run by run."""
    seen, out = set(), []
    for _, text in rows:
        worded = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.split()]
        covered = set()
        for b in range(len(worded)):  # in order of the end, as equal runs of one text overlap
            for a in range(b + 1):
                run = tuple(x for _, x in worded[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        covered.update(range(worded[a][0], worded[b][0] + 1))
                    seen.add(run)
        out.append("\n".join(x for p, x in enumerate(text.split("\n")) if p not in covered))
    return out


def test_runs_reach_as_far_as_they_repeat(spark):
    import random

    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randrange(0, 16)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for min_words in (1, 9, 14):
        got = {r.doc_id: r.text for r in lines.deduplicated(docs, min_words=min_words).collect()}
        # Blank lines between windows may stay.
        worded = lambda t: [x for x in t.split("\n") if x.split()]
        assert {i: worded(t) for i, t in got.items()} == dict(enumerate(map(worded, maximal_runs(rows, min_words))))


def test_the_last_lines_of_a_run_go_too(spark):
    passage = " ".join(f"a{i}" for i in range(60)) + "\n" + " ".join(f"b{i}" for i in range(45))
    rows = [(k, f"{passage}\nown {k} end") for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert got == {1: rows[0][1], 2: "own 2 end"}


def test_a_very_long_text_and_a_very_long_line(spark):
    many = "\n".join(f"line {i} of the long text" for i in range(20_000))
    one = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, many), (2, "own\n" + many), (3, one), (4, one + "\nown")]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: many, 2: "own", 3: one, 4: "own"}


def test_a_line_that_half_the_documents_share(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_PARTS", 3)
    common_line = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"{common_line}\nown {i}" if i % 2 else f"own {i}\n" + " ".join(f"u{i // 4}w{j}" for j in range(55))) for i in range(80)]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == dict(enumerate(maximal_runs(rows, 50)))
