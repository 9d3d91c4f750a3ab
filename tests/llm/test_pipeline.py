import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_lines import maximal_runs
from test_rules_and_mixing import filled
from test_simhash import reference_print, roots_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tallyworks.functions.lineage import materialise
from tallyworks.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


def near_roots(rows):
    prints = [reference_print(t) for _, t in rows]
    return roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    columns = docs.columns
    (_, without_toxic), (_, line_dedup), (_, near_dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = materialise(without_toxic(spark, docs, SF), "kept")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    chain = toxicity.train(docs, toxicity.by_language(spark.read.parquet(f"{SF}/labels.parquet"), docs), toxicity.CATEGORIES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept.columns == columns and ids == {i for i, t in texts.items() if max(chain.probabilities(t)) < 0.5}
    assert len(toxic - ids) >= 0.5 * len(toxic) and known - toxic <= ids

    cleaned = materialise(line_dedup(spark, kept, SF), "cleaned")
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    want = maximal_runs(rows, 50)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in cleaned.collect())
    assert cleaned.columns == columns and got == [(i, t, len(t)) for (i, _), t in zip(rows, want)]

    single = materialise(near_dedup(spark, cleaned, SF), "single")
    rows = [(i, t) for i, t, _ in got]
    least = near_roots(rows)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k][0] for k in least})

    mixed = materialise(mix(spark, single, SF), "mixed")
    sources, taken = Counter(), Counter()
    sizes = {r.doc_id: (r.source, len(r.text.encode().split())) for r in single.collect()}
    for s, n in sizes.values():
        sources[s] += n
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        taken[sizes[i][0]] += n * sizes[i][1]
    names = sorted(sources)
    targets = filled([sources[s] for s in names], [1 + k % 3 for k in range(len(names))], sum(sources.values()), 3.0)
    longest = {s: max(n for t, n in sizes.values() if t == s) for s in names}
    assert mixed.columns == columns and max(copies.values()) <= 3
    assert all(abs(taken[s] - t) <= longest[s] for s, t in zip(names, targets))

    pieces = pack(spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    whole = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}
    seen, ends = Counter(), Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
        assert zlib.crc32(p.ids) == zlib.crc32(whole[p.doc_id][4 * p.start : 4 * (p.start + p.length)])
        seen[p.doc_id] += p.length
    assert max(ends.values()) <= 2048
    assert seen == {i: n * len(whole[i]) // 4 for i, n in copies.items()}


def test_run_gives_what_the_stages_give(spark):
    result = entry.queries()["pipeline"](spark, SF)
    assert result.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert result.agg(F.sum("length")).first()[0] > 0
    assert "pipeline" not in entry.oracle_sql()
    ops = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert ops == set(range(1, 14))


def test_texts_go_to_python_a_hundred_at_a_time(spark):
    """Arrow would hold 10,000 whole texts a task on either side, which is what took the executors' memory."""
    docs = spark.createDataFrame([(i, "a few words here") for i in range(3)] + [(None, None)], "doc_id long, text string")
    chain = toxicity.Chain(("toxic",), {"=few": 0}, [np.array([2.0, -1.0])])
    scored, prints = toxicity.without_toxic(docs, chain), simhash.fingerprints(docs)
    assert [r.doc_id for r in scored.collect()] == [None]
    assert {r.doc_id: r.fingerprint for r in prints.collect()}[None] == 0
    for df in (scored, prints):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
