"""Near duplicates by SimHash, with candidates found by pigeonring filtering.

A fingerprint of ``64 * words`` bits is cut into ``segments`` on a ring. If two of them differ in
at most ``budget`` bits, some segment starts a chain all of whose first l segments together
differ in at most ``l * budget / segments`` bits, for every l. A chain long enough to be selective
is the join key: one side is filed under its value, the other asks for all values that the
budgets allow. The longer chains and the full distance are checked within the join.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tallyworks.functions.lineage import materialise
from tallyworks.llm.common import ROW, row_only, with_row
from tallyworks.llm.graph import components

SEED = 42
# Words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE, BUDGET = 3, 3
# Bits of a join key: so many that unrelated fingerprints hardly meet.
KEY_BITS = 32
# Hashes voted on at a time, which bounds the memory for long texts.
VOTED_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, in order and repeats included.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A text of
    fewer words has one shingle, one without words none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    runs = map(b" ".join, zip(*[found[i:] for i in range(size)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64, count=len(found) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), VOTED_AT_ONCE):
        part = hashes[start : start + VOTED_AT_ONCE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint): a hash of each whole text, and its SimHash over its ``shingle``-word runs as a long.

    Null, empty and blank texts have fingerprint zero. Repeated rows give a row each.
    """

    # Rows go to Python 100 at a time, so neither side holds thousands of whole texts.
    @F.udf(T.LongType(), useArrow=False)
    def of(text: str | None) -> int:
        return simhash(shingle_hashes(text, shingle))

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), _text_key(text_col).alias("text_key"), of(F.col(f"`{text_col}`").cast("string")).alias("fingerprint"))


# --- pigeonring ---------------------------------------------------------------


def _chain_masks(start: int, length: int, width: int, words: int) -> list[int]:
    """Per 64-bit word the bits of ``length`` segments from ``start`` on around the ring, signed."""
    segments = 64 * words // width
    masks = [0] * words
    for s in range(start, start + length):
        bit = s % segments * width
        masks[bit // 64] |= ((1 << width) - 1) << bit % 64
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _allowed(length: int, width: int, budget: int, segments: int) -> list[int]:
    """Bit patterns over a chain, first segment highest, that keep within the budget of each of its prefixes."""
    bits, kept = length * width, []
    for flips in range(length * budget // segments + 1):
        for places in combinations(range(bits), flips):
            if all(sum(p < l * width for p in places) <= l * budget // segments for l in range(1, length + 1)):
                kept.append(sum(1 << bits - 1 - p for p in places))
    return kept


def within_budget(prints: DataFrame, words: list[str], *, key: str, budget: int = BUDGET, segments: int = 4) -> DataFrame:
    """Pairs of rows of ``prints`` (aliases ``a`` and ``b``) whose fingerprints differ in at most ``budget`` bits.

    ``words`` names the 64-bit columns of a fingerprint, ``key`` the column that tells rows apart. A pair may
    come more than once; which of the two is ``a`` is not said.
    """
    width = 64 * len(words) // segments
    length = -(-KEY_BITS // width)
    patterns = _allowed(length, width, budget, segments)

    def value(start: int) -> Column:
        out = F.lit(0).cast("long")
        for s in range(start, start + length):
            bit = s % segments * width
            part = F.shiftrightunsigned(F.col(words[bit // 64]), bit % 64).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return out

    chains = F.array(*[F.struct(F.lit(s).alias("start"), value(s).alias("value")) for s in range(segments)])
    filed = prints.withColumn("chain", F.explode(chains))
    filed = filed.select("*", F.col("chain.start").alias("start"), F.col("chain.value").alias("value")).drop("chain")
    asked = filed
    if patterns != [0]:
        asked = filed.withColumn("pattern", F.explode(F.array(*[F.lit(p).cast("long") for p in patterns])))
        # Of two rows that differ by a pattern, the one without its lowest bit asks.
        lowest = F.col("pattern").bitwiseAND(-F.col("pattern"))
        asked = asked.where(F.col("value").bitwiseAND(lowest) == 0)
        asked = asked.withColumn("value", F.col("value").bitwiseXOR(F.col("pattern"))).drop("pattern")

    def differing(masks: list[int] | None) -> Column:
        parts = []
        for i, w in enumerate(words):
            x = F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))
            parts.append(F.bit_count(x if masks is None else x.bitwiseAND(F.lit(masks[i]).cast("long"))))
        return sum(parts[1:], parts[0])

    on = (F.col("a.start") == F.col("b.start")) & (F.col("a.value") == F.col("b.value"))
    for l in range(length, segments):
        by_start = [differing(_chain_masks(s, l, width, len(words))) for s in range(segments)]
        within = F.lit(False)
        for s, d in enumerate(by_start):
            within = within | ((F.col("a.start") == s) & (d <= l * budget // segments))
        on = on & within
    # Where a row asks for its own value alone, both would find the other.
    on = on & (F.col(f"a.{key}") < F.col(f"b.{key}") if patterns == [0] else F.col(f"a.{key}") != F.col(f"b.{key}"))
    on = on & (differing(None) <= budget)
    # Spark takes an exploded table to be no larger than what it was made from, so it would broadcast these.
    return asked.alias("a").join(filed.alias("b").hint("merge"), on)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fingerprint) of every row, and (fingerprint, root, component_id) of every fingerprint.

    Copies share a fingerprint, and links are sought between different fingerprints only, so that
    a group of copies is one node whatever its size.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    ring = nodes.select("fingerprint")
    pairs = within_budget(ring, ["fingerprint"], key="fingerprint", budget=budget)
    roots = components(pairs.select(F.col("a.fingerprint").alias("u"), F.col("b.fingerprint").alias("v")))
    # There may be a node per text, and a row takes several times as much in memory as in the file that Spark goes by: nothing is broadcast.
    members = materialise(roots.join(nodes.hint("merge"), F.col("node") == F.col("fingerprint")), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = members.select("fingerprint", "root").join(least.hint("merge"), "root")
    root, component = F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "least").alias("component_id")
    # Written, so that the rows of many copies meet it as a table of its own, whose join Spark splits where it is uneven.
    return prints, materialise(nodes.join(reached.hint("merge"), "fingerprint", "left").select("fingerprint", root, component), "named")


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints link at ``budget`` or fewer
    differing bits, with the least ``doc_id`` that links reach.

    Every row has a result. A null ``doc_id`` is reached like any other, but never names a component unless there is no other.
    """
    prints, named = _grouped(docs, id_col, text_col, shingle, budget)
    return prints.join(named.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` of which each component of :func:`linked` keeps one: its least by ``doc_id``, then by a hash of the text.

    Of repeated rows one stays. A null ``doc_id`` comes after all others. Texts without words, null ones too, are copies of
    each other. An empty table gives no rows.
    """
    prints, named = _grouped(docs, id_col, text_col, shingle, budget)
    rows = prints.join(named.select("fingerprint", "root").hint("merge"), "fingerprint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("f")
    keep = rows.groupBy("root").agg(first).select(F.col("f.id").alias("_id"), F.col("f.key").alias("_key"))
    keep = materialise(keep, "keep")
    keyed = with_row(docs, doc_id=F.col(f"`{id_col}`"), text_key=_text_key(text_col))
    kept = keyed.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    # Rows of one id and text that repeat; there may be many, so all but one go before they meet.
    return row_only(kept.groupBy("doc_id", "text_key").agg(F.first(ROW).alias(ROW)).select(ROW))


def _text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
