"""Spelling variants: words one edit apart, found by walking a trie that is a table.

A node of the trie is the path that leads to it, an edge a row (node, next character); so the trie is as
distributed as any table. A state (word, position, node, edits) says that the word up to the position, with
so many edits, spells the node. The frontier of states is joined with the edges of its depth, level by level;
a state with one edit whose word is used up, at a node that is a word, shows two neighbours.

An edit in the second half of a word leaves the first half as it is, one in the first half the second.
The words are therefore walked twice, forwards and backwards, and edits tried in the second half only: deep
in the trie, where nodes have few edges and no node is shared by a large part of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.functions.lineage import materialise, stage_path
from tallyworks.llm.common import lower_ascii

# Fixed value: letters of a run.
RUN = r"[A-Za-zÀ-ÿ]"
# Longer words are compared by halves, so that the number of levels is bounded.
LONGEST = 48
# Both directions of the walk.
FORWARDS, BACKWARDS = "f", "b"


def counted(docs: DataFrame, *, least_length: int = 7, least_count: int = 2, divisor: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of Latin letters, A-Z in lower case. Where ``divisor`` divides the CRC-32 h of
    ``<id>:<run>``, the run's code point h % length is deleted. Null texts have no runs; a null id is written
    as an empty text. Repeated rows count as often as they stand.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"({RUN}{{{least_length},}})"), 1))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.withColumn("run", F.when(F.rlike("run", F.lit("[A-Z]")), lower_ascii(F.col("run"))).otherwise(F.col("run")))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run")), F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _char(text: Column, at: Column) -> Column:
    """The character at a place from 0; empty beyond the end."""
    return F.substring(text, (at + 1).cast("int"), F.lit(1))


def _sides(words: DataFrame) -> DataFrame:
    """(side, word, size, low): each word and its reverse, and the depth from which edits are tried."""
    half = F.floor(F.col("size") / 2).cast("int")
    sized = words.select("word", F.length("word").alias("size"))
    forwards = sized.select(F.lit(FORWARDS).alias("side"), "word", "size", half.alias("low"))
    backwards = sized.select(F.lit(BACKWARDS).alias("side"), F.reverse("word").alias("word"), "size", (F.col("size") - half).alias("low"))
    return forwards.union(backwards)


def edge_table(sides: DataFrame) -> DataFrame:
    """(side, depth, node, kids): the nodes in the lower half of the tries, each with its next characters as one text."""
    # A word as long as another or one shorter is met at half its own length at the earliest.
    depth = F.explode(F.sequence(F.floor(F.col("size") / 2).cast("int"), F.col("size") - 1))
    edges = sides.select("side", "word", depth.alias("depth"))
    edges = edges.select("side", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), _char(F.col("word"), F.col("depth")).alias("kid"))
    return edges.groupBy("side", "depth", "node").agg(F.array_join(F.collect_set("kid"), "").alias("kids"))


def walked(words: DataFrame) -> DataFrame:
    """(a, b): words one edit apart, each pair at least once."""
    spark = words.sparkSession
    sides = materialise(_sides(words), "sides")
    edges = edge_table(sides)
    edges = materialise(edges, "edges")
    span = sides.agg(F.min(F.floor(F.col("size") / 2)).cast("int"), F.max("size")).first()
    if span[0] is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    paths, frontier = [], None
    word, pos = F.col("word"), F.col("pos")
    for depth in range(span[0], span[1]):
        # Words without an edit so far stand at the node that they spell.
        whole = sides.where((F.col("low") <= depth) & (F.col("size") > depth))
        whole = whole.select("side", "word", "size", F.lit(depth).alias("pos"), F.substring("word", F.lit(1), F.lit(depth)).alias("node"), F.lit(0).alias("edits"))
        states = whole if frontier is None else whole.unionByName(frontier.where("pos < size"))
        here = edges.where(F.col("depth") == depth).select("side", "node", "kids")
        met = states.join(here, ["side", "node"])
        # The next states: position and the character followed.
        unedited, wanted, after = F.col("edits") == 0, _char(word, pos), _char(word, pos + 1)
        # A replaced character is tried in one order, the pair's other word would find the same.
        replaced = F.transform(
            F.filter(F.split("kids", ""), lambda k: (k != "") & (k > wanted)), lambda k: F.struct((pos + 1).alias("pos"), k.alias("kid"))
        )
        deleted = F.when((after != "") & F.contains(F.col("kids"), after), F.array(F.struct((pos + 2).alias("pos"), after.alias("kid"))))
        matched = F.when(F.contains(F.col("kids"), wanted), F.array(F.struct((pos + 1).alias("pos"), wanted.alias("kid"))))
        none = F.array().cast("array<struct<pos:int,kid:string>>")
        steps = F.when(unedited, F.concat(replaced, F.coalesce(deleted, none))).otherwise(F.coalesce(matched, none))
        moved = met.select("side", "word", "size", "node", F.explode(steps).alias("to"))
        moved = moved.select("side", "word", "size", F.col("to.pos").alias("pos"), F.concat("node", "to.kid").alias("node"), F.lit(1).alias("edits"))
        paths.append(stage_path(spark, "frontier"))
        moved.write.parquet(paths[-1])
        frontier = spark.read.schema(moved.schema).parquet(paths[-1])
    # One scan of all levels' states whose word is used up, and every word's own path without its last character.
    used_up = spark.read.schema(moved.schema).parquet(*paths).where("pos = size").select("side", "word", "node")
    less_last = sides.select("side", "word", F.substring("word", F.lit(1), F.col("size") - 1).alias("node"))
    ends = used_up.union(less_last)
    turned = [F.when(F.col("side") == BACKWARDS, F.reverse(c)).otherwise(F.col(c)).alias(n) for c, n in (("word", "a"), ("node", "b"))]
    # A node at which a word is used up counts where it is a word itself.
    return ends.select(*turned).join(words.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b")


def by_halves(words: DataFrame, longest: int) -> DataFrame:
    """(a, b): words one edit apart of which one at least is longer than ``longest``.

    One edit leaves the first or the second half of the shorter word, or of either if they are as long, in
    its place. Words of nearly the same length that share such a half are compared.
    """
    sized = words.select("word", F.length("word").alias("size")).where(F.col("size") >= longest)
    # As the pair's shorter word, and as the one that is longer by one.
    roles = sized.withColumn("short", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    half = F.floor(F.col("short") / 2).cast("int")
    head = F.struct(F.lit(FORWARDS).alias("side"), F.xxhash64(F.substring("word", F.lit(1), half)).alias("half"))
    tail = F.struct(F.lit(BACKWARDS).alias("side"), F.xxhash64(F.substring("word", F.col("size") - (F.col("short") - half) + 1, F.col("size"))).alias("half"))
    keyed = roles.select("word", "size", "short", F.explode(F.array(head, tail)).alias("key")).select("word", "size", "short", "key.side", "key.half")
    a, b = keyed.where("size = short").alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.side") == F.col("b.side")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.short") == F.col("b.short")))
    pairs = pairs.where((F.col("b.size") > F.col("a.size")) | (F.col("a.word") < F.col("b.word"))).where(F.col("b.size") > longest)
    return pairs.where(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))


def neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, b): all pairs of distinct words exactly one inserted, deleted or replaced code point apart, each once.

    ``words`` has distinct, non-null ``word``. Up to ``longest`` code points they are found in the trie,
    pairs with a longer word by halves.
    """
    words = words.select("word")
    short = walked(words.where(F.length("word") <= longest))
    long = by_halves(words, longest)
    return short.union(long).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(words: DataFrame, *, times: int = 10, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its near words' number, its form and its root.

    ``words`` has distinct ``word`` and its number of occurrences ``n``. The form is the near word of
    largest ``n`` (of equal ones the smallest in code-point order) if that is at least ``times`` the word's own,
    else null; the root the last word that forms lead to, the word itself if it has none. No words, no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(neighbours(words, longest), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The least of (-n, word) is the near word of largest n, the smallest of equal ones.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    rows = materialise(rows, "forms")
    roots = followed(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) links to each word's last; what a link leads to is followed, twice as far each round.

    Forms are ``times`` as frequent as their words, so a chain is no longer than the digits of the largest count.
    """
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialise(links.join(onward, "root", "left"), "roots")
        links = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further is not null").isEmpty():
            return links
