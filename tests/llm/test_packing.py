import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyworks.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_runs_place_every_piece_once():
    rng = np.random.default_rng(1)
    for size in (1, 7, 64):
        lengths = Counter(int(x) for x in rng.integers(1, size + 1, 500))
        used, placed = defaultdict(list), Counter()
        for length, lo, hi, first, offset in packing.packed_runs(dict(lengths), size):
            placed[length] += hi - lo
            for i in range(hi - lo):
                used[first + i].append((offset, length))
        assert placed == lengths
        assert sorted(used) == list(range(len(used)))
        for parts in used.values():
            ends = 0
            for offset, length in sorted(parts):
                assert offset == ends
                ends += length
            assert ends <= size


def test_plan_is_as_long_for_any_number_of_documents():
    few = packing.packed_runs({k: 5 for k in range(1, 257)}, 256)
    many = packing.packed_runs({k: 5_000_000_000 for k in range(1, 257)}, 256)
    assert len(many) <= len(few) + 512


def test_words_give_the_ids_of_whole_texts(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["It's A\ttest\u00a0of\u0085words <|endoftext|> x\u0301 \u0301y I\u0307 J\u030c", " ", "\x1cab\x1d", "ǅ ΑΣ ß 12 3.5e#@!'ll", "It's IT'S Don't!! Été. ÉTÉ. été!! naïve, e\u0301! J\u030c. x—. —. a'. A1! <|startoftext|>. x<|. K Å ½."]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids = list(packing.WordTokens(PATH).of(texts))
    for text, found in zip(texts, ids):
        assert np.frombuffer(found, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("n_chars").alias("ids"))
    extra = spark.createDataFrame([(None, None, 1), (9001, "", 1), (9002, "same", 1), (9002, "same", 1)], "doc_id long, text string, ids long")
    docs = docs.unionByName(extra).repartition(5)
    pieces = packing.pack(docs, PATH, max_length=256).cache()
    rows = pieces.collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    for d in docs.collect():
        if d.doc_id in (9002,):
            continue
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        mine = sorted(parts[d.doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in mine)
        assert [r.start for r in mine] == list(range(0, len(ids), 256))
    assert [r.length for r in parts[9002]] == [2, 2]
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 256 and sorted(ends) == list(range(len(ends)))
    assert sum(256 * len(ends) - sum(ends.values()) for _ in [0]) < 0.02 * sum(ends.values())
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {s: r.n_tokens for s, r in whole.items()} == dict(ends)
    one = min(rows, key=lambda r: (r.sequence_id, r.offset))
    assert bytes(whole[one.sequence_id].ids).startswith(bytes(one.ids))
    assert pieces.where(F.crc32("ids") != -1).count() == len(rows) and zlib.crc32(b"") == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_takes_hardly_more_sequences_than_first_fit():
    """Plain first fit by falling length, a piece at a time; pieces of one length that open packs do so at once, which costs some."""
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 257, 2000), rng.lognormal(4, 1, 2000).astype(int).clip(1, 256)):
        room = []
        for length in sorted(map(int, sizes), reverse=True):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                room.append(256 - length)
            else:
                room[at] -= length
        runs = packing.packed_runs(Counter(map(int, sizes)), 256)
        sequences = max(first + hi - lo for _, lo, hi, first, _ in runs)
        assert sequences <= 1.03 * len(room)
        assert sequences >= -(-int(sizes.sum()) // 256)


def test_words_are_remembered_across_generations(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_REMEMBERED", 8)
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 2)
    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    texts = [" ".join(["the", *(f"w{k}x" for k in rng.integers(0, 30, 6)), "and!"]) for _ in range(40)]
    words = packing.WordTokens(PATH)
    for text, found in zip(texts, words.of(texts)):
        assert np.frombuffer(found, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # A group of texts at most beyond the bound; parts of words are remembered too.
    assert len(words.ids) + len(words.older) < 100


def test_parts_of_words_are_remembered_once(monkeypatch):
    """Neither capitals nor signs make a word another, however often it is met; nor do groups change what a text gives."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["Word!! word, WORD. it's", None, "", "word!! Über, über. über", " \n"] * 3
    whole = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for at_once in (1, 30, 1 << 20):
        monkeypatch.setattr(packing, "BYTES_AT_ONCE", at_once, raising=False)
        words = packing.WordTokens(PATH)
        for _ in range(2):
            assert [np.frombuffer(i, "<u2").tolist() for i in words.of(texts)] == whole
        assert set(words.ids) - {b""} == {w.encode() for w in ("word", "!!", ",", ".", "it's", "Über", "über")}


def test_pieces_come_back_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_AT_ONCE", 3, raising=False)
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, PATH, max_length=16).collect()
    assert sum(r.length for r in rows) == sum(2 * i + 1 for i in range(40))
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
