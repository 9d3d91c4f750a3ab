import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm import graph, simhash

SF = "/root/testdata/sf0.001"


def reference_print(text, k=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_linked_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "One"), (9005, "two words"), (9004, "One")], "doc_id long, text string")
    )
    rows = sorted((r.doc_id, r.text) for r in docs.na.fill("").collect())
    prints = [reference_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    least = roots_of(len(rows), links)
    got = sorted(tuple(r) for r in simhash.linked(docs).collect())
    want = sorted((d, p - (1 << 64) if p >> 63 else p, rows[least[i]][0]) for i, ((d, _), p) in enumerate(zip(rows, prints)))
    assert got == want


def test_every_pair_within_the_budget_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(p) for p in rng.choice(63, n, replace=False)) for n in range(6) for b in base]
    values = sorted(set(map(int, base)) | set(near))
    prints = spark.createDataFrame([(v,) for v in values], "w long")
    pairs = simhash.within_budget(prints, ["w"], key="w").select("a.w", "b.w").collect()
    got = {frozenset(r) for r in pairs}
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {frozenset((x, y)) for x in values for y in values if x < y and far(x, y) <= 3}


def test_chains_allow_exactly_what_the_budgets_do():
    assert len(simhash._allowed(2, 16, 3, 4)) == 17
    assert simhash._allowed(1, 32, 3, 4) == [0]


def test_components_are_those_of_a_search(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    least = roots_of(400, links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links + links[:5], "u int, v int")).collect()}
    assert got == {n: least[n] for link in links if link[0] != link[1] for n in link}
    assert graph.components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_one_document_of_each_component_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    least = {r.component_id for r in simhash.linked(docs).collect()}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(least)
    assert 0 < len(least) < docs.count()


def test_deduplicated_handles_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (3, text.upper(), 2), (3, text.upper(), 2), (None, text, 3), (7, None, 4), (8, "", 5), (9, "one", 6), (None, None, 7), (None, "alone here", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumns({c: F.lit("z") for c in ("fingerprint", "root", "node", "text_key", "least")})
    got = sorted((r.doc_id or 0, r.n) for r in simhash.deduplicated(docs).collect())
    assert got == [(0, 8), (3, 2), (7, 4), (9, 6)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.linked(docs).collect()) == sorted(
        [(5, 3), (3, 3), (3, 3), (0, 3), (7, 7), (8, 7), (9, 9), (0, 7), (0, 0)]
    )
    assert simhash.deduplicated(docs.limit(0)).count() == 0
    assert simhash.linked(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(200_000))
    hashes = simhash.shingle_hashes(long, 3)
    assert len(hashes) > 2 * simhash.VOTED_AT_ONCE
    ones = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)).sum(0)
    want = sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(hashes))
    assert simhash.simhash(hashes) & (2**64 - 1) == want
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [1, 3]


def test_no_broadcast_grows_with_the_texts(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(900)]
    # Only links may be broadcast, and here are few of them.
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:200])], "doc_id long, text string")
    prints = [reference_print(t) for t in texts]
    assert all((p ^ q).bit_count() > 3 for i, p in enumerate(prints) for q in prints[:i])
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "16k")
    try:
        assert sorted((r.doc_id, r.component_id) for r in simhash.linked(docs).collect()) == [(i, i % 900) for i in range(1100)]
        assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(900))
    finally:
        spark.conf.unset(limit)
