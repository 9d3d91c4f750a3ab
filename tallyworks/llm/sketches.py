"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has three tables of cells. Every distinct paragraph of a text is digested and put into
one cell of each table; a cell keeps how many digests it holds, their XOR and the XOR of their
check sums. Subtracting two versions' sketches cell by cell leaves what differs. A cell left with
one digest shows it; taking it out of its other cells may leave those with one, and so on. If
cells remain, the sketches were too small for the difference, and larger ones are made.

Cells are rows, so a sketch costs what it holds, not what it has room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise

TABLES = 3
# Cells per table of the sketches that are compared; each retry has so many times more. Cells are
# rows, so empty ones cost nothing.
CELLS, GROWTH = 1024, 64
# Cells per table of a printed fingerprint. A cell's place in a small sketch is its place in a
# large one modulo the small one's cells, so the print is the compared sketch folded.
PRINTED = 32
# Steps of peeling, each through one table in turn, before a larger sketch is tried.
STEPS = 4

# A paragraph: a sentence, or a part of one, of up to 16 words of a line.
_GAP = r"[\x20\x09\x0B-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
PARAGRAPH = rf"(?:{_WORD}*[^\x20\x09-\x0D.!?]{_GAP}+){{0,15}}{_WORD}+"

# Rows of a block, in which neighbours are found, and the most blocks.
BLOCK_ROWS, MOST_BLOCKS = 1024, 1 << 16
BLOCKS_A_TASK = 2

PAIR = ["block", "pair", "side"]


def digests(text: Column) -> Column:
    """The digests of a text's distinct paragraphs; none for a blank text. Null counts as empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


# Written as SQL, of which a step of peeling is one expression.
_CHECK = "xxhash64({0}, 1048576)"


def _cell(digest: str, table: int, cells: int) -> str:
    """The cell of a digest in a table."""
    return f"({table * cells}L + pmod(xxhash64({digest}, {table}), {cells}L))"


def sketch(rows: DataFrame, keys: list[str], digest_array: str, cells: int) -> DataFrame:
    """``keys``, cell, held, digests, checks: the cells in use of each row's sketch.

    One row of ``rows`` has all digests of its key, so a partitioning by any of the keys serves.
    """
    each = rows.select(*keys, F.explode(digest_array).alias("digest"))
    in_each = ", ".join(_cell("digest", t, cells) for t in range(TABLES))
    placed = each.selectExpr(*keys, "digest", f"explode(array({in_each})) AS cell")
    sums = ("count(*) AS held", "bit_xor(digest) AS digests", f"bit_xor({_CHECK.format('digest')}) AS checks")
    return placed.groupBy(*keys, "cell").agg(*map(F.expr, sums))


def peeled(differences: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """``keys``, cell, found, held, digests, checks: subtracted sketches after peeling.

    Rows with ``found`` are recovered digests, ``held`` 1 if the first version has them and -1 if the
    second. Rows without are cells that could not be peeled. The steps visit the tables one after the
    other: a digest has one cell in each, so no step recovers it twice.
    """
    state = differences.selectExpr(*keys, "cell", "CAST(NULL AS BIGINT) AS found", "held", "digests", "checks")

    def row(cell: str, found: str, held: str, digests: str, checks: str) -> str:
        return f"named_struct('cell', {cell}, 'found', {found}, 'held', {held}, 'digests', {digests}, 'checks', {checks})"

    same = row("cell", "found", "held", "digests", "checks")
    recovered = row("-1L", "digests", "held", "0L", "0L")
    sums = [F.expr(f"{f}({c}) AS {c}") for f, c in (("sum", "held"), ("bit_xor", "digests"), ("bit_xor", "checks"))]
    for step in range(STEPS):
        table = step % TABLES
        pure = f"found IS NULL AND abs(held) = 1 AND checks = {_CHECK.format('digests')} AND cell = {_cell('digests', table, cells)}"
        others = [row(_cell("digests", t, cells), "CAST(NULL AS BIGINT)", "-held", "digests", "checks") for t in range(TABLES) if t != table]
        state = state.selectExpr(*keys, f"inline(if({pure}, array({', '.join([recovered, *others])}), array({same})))")
        state = state.groupBy(*keys, "cell", "found").agg(*sums).where("held <> 0 OR digests <> 0 OR checks <> 0")
    return state


def printed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, print: a sketch as text, its cells in use in order as cell.held.digests.checks."""
    checks = F.col("checks").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    one = F.concat_ws(".", F.hex("cell"), F.hex("held"), F.hex("digests"), F.hex(checks))
    listed = F.array_sort(F.collect_list(F.struct("cell", one.alias("text"))))  # at most all cells of a sketch
    return cells.groupBy(*keys).agg(F.concat_ws("-", F.transform(listed, lambda c: c["text"])).alias("print"))


# --- neighbours -------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str) -> tuple[list, int]:
    """Ids that part the table into ranges of about ``BLOCK_ROWS`` rows, in falling order, from a hashed sample.

    The sample decides how even the ranges are and nothing else; it has some 8 ids a block.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    rows = ids.count()
    blocks = max(1, min(MOST_BLOCKS, rows // BLOCK_ROWS))
    if blocks == 1:
        return [], rows
    one_in = max(1, rows // (8 * blocks))
    drawn = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)).distinct().orderBy(F.desc("id")).collect()
    step = max(1, len(drawn) // blocks)
    return [r["id"] for r in drawn[step::step]], rows


def _block_of(value: Column, edges: list, kind: str) -> Column:
    """How many of the falling ``edges`` lie above or at a value, looked up in two levels; null comes last."""
    wide = max(1, int(len(edges) ** 0.5))
    parts = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    if not edges:
        return F.lit(0)
    listed = F.array(*[F.array(*[F.lit(e).cast(kind) for e in p]) for p in parts])
    at_or_above = lambda edge: edge >= value
    passed = F.size(F.filter(listed, lambda p: at_or_above(F.element_at(p, -1))))
    inside = F.size(F.filter(F.coalesce(F.get(listed, passed), F.array().cast(f"array<{kind}>")), at_or_above))
    return F.when(value.isNull(), F.lit(len(edges))).otherwise(passed * wide + inside).cast("int")


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, pos, ghost, doc_id, text, next_text: every row beside the text of the next by falling id.

    After the last row comes the first again; a table of one row is its own next. Null ids come
    last; rows of one id are ordered by text. Null texts are empty.

    Rows are dealt to blocks by ranges of ids. The first row of every block also goes, as a ghost, to
    the end of the block before, so the texts are shuffled once and no task sees more than a block.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    edges, _ = _blocks(docs, id_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("block", _block_of(F.col("doc_id"), edges, kind))
    # A row per block, at most MOST_BLOCKS.
    firsts = rows.groupBy("block").agg(F.max("doc_id").alias("first_id")).orderBy("block").collect()
    before = [(r["first_id"], r["block"], firsts[i - 1]["block"]) for i, r in enumerate(firsts)]
    ahead = docs.sparkSession.createDataFrame(before, f"first_id {kind}, first_block int, to_block int")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("block") == F.col("first_block"))
    marked = rows.join(F.broadcast(ahead), is_first, "left")
    homes = F.array(F.struct("block", F.lit(False).alias("ghost")))
    both = F.when(F.col("to_block").isNull(), homes).otherwise(F.concat(homes, F.array(F.struct(F.col("to_block").alias("block"), F.lit(True).alias("ghost")))))
    dealt = marked.select("doc_id", "text", F.explode(both).alias("home")).select("home.block", "home.ghost", "doc_id", "text")
    order = Window.partitionBy("block").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    near = dealt.select(
        "*", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"), F.lag("ghost").over(order).alias("before")
    )
    return near.where("NOT ghost OR NOT before").drop("before")


# --- fingerprints and likeness --------------------------------------------------------


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half of code points replaced by as many of the first of ``other``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, retries.

    Every text, its edited version (see ``edited``, with the next text by falling id) and the next text are
    sketched; subtracting and peeling the sketches tells how many paragraphs differ. Likeness is
    the share of paragraphs in common, twice the common ones over those of both; 1 for two texts
    without any. Null and empty texts have an empty fingerprint. Repeated rows give a row each.
    ``retries`` is the number of larger sketches that the harder of the two comparisons took.

    The texts are shuffled once; what is written and shuffled after that are digests. Failed pairs
    alone go on to larger sketches, until none is left.
    """
    near = with_next(docs, id_col=id_col, text_col=text_col)
    own = F.when(~F.col("ghost"), F.col("text"))
    rows = near.select(
        "block", "pos", "ghost", "doc_id", F.length(own).cast("long").alias("n_chars"), "text", F.when(~F.col("ghost"), edited(F.col("text"), F.col("next_text"))).alias("edit")
    )
    rows = rows.select(
        "block", "pos", "ghost", "doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), F.when(~F.col("ghost"), digests(F.col("edit"))).alias("edit"),
    )
    rows = materialise(rows, "digests")
    # Digests grow into cells, so tasks are counted by blocks and not by the bytes they read.
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_A_TASK)

    # Pair p of a block is row p with its edited version (side 0) and with the next row (side 1).
    wanted, cells, recovered, retry = rows, CELLS, None, 0
    while True:
        found = peeled(_subtracted(wanted, cells, retry == 0, tasks), PAIR, cells)
        failed = F.max(F.col("found").isNull())
        counts = found.groupBy(*PAIR).agg(
            failed.alias("failed"),
            F.count(F.when(F.col("found").isNotNull() & (F.col("held") > 0), 1)).alias("only_first"),
            F.count(F.when(F.col("found").isNotNull() & (F.col("held") < 0), 1)).alias("only_second"),
        )
        counts = materialise(counts.withColumn("retries", F.lit(retry)), "peeled")
        done = counts.where("NOT failed").drop("failed")
        recovered = done if recovered is None else recovered.union(done)
        left = counts.where("failed").select(*PAIR)
        if not left.limit(1).count():
            break
        retry, cells = retry + 1, cells * GROWTH
        wanted = _of_pairs(rows, left)
    sides = recovered.groupBy("block", F.col("pair").alias("pos")).agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in (0, 1) for c in ("only_first", "only_second")], F.max("retries").alias("retries")
    )
    prints = _prints(rows, tasks)
    joined = prints.join(sides, ["block", "pos"], "left")

    def likeness(side: int) -> Column:
        first, second = (F.coalesce(F.col(f"{c}_{side}"), F.lit(0)) for c in ("only_first", "only_second"))
        # What the sketch of a text counts, less what peeling found in it alone, is in both.
        common = F.col("n_own") - first
        return F.when(2 * common + first + second > 0, 2 * common / (2 * common + first + second)).otherwise(F.lit(1.0))

    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(0).alias("near_edited"), likeness(1).alias("near_next"), F.coalesce("retries", F.lit(0)).alias("retries"),
    )


def _contributions(first: bool) -> Column:
    """Which differences a sketch enters, and with which sign.

    All of them: a row's own sketch is first against its edited version and the next row, and second for
    the row before; the edited one is second. On a retry the row says itself.
    """
    if not first:
        return F.col("enters")
    entry = lambda pair, side, sign: F.struct(pair.alias("pair"), F.lit(side).alias("side"), F.lit(sign).cast("long").alias("sign"))
    pos = F.col("pos")
    before = F.when(pos > 1, F.array(entry(pos - 1, 1, -1))).otherwise(F.array().cast("array<struct<pair:int,side:int,sign:bigint>>"))
    own = F.when(F.col("ghost"), before).otherwise(F.concat(F.array(entry(pos, 0, 1), entry(pos, 1, 1)), before))
    return F.when(F.col("which") == 0, own).otherwise(F.array(entry(pos, 0, -1)))


def _versions(rows: DataFrame, extra: list[str]) -> DataFrame:
    """A row per text and edited text with its digests, kept in the blocks they came from."""
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("own").alias("digests")), F.struct(F.lit(1).alias("which"), F.col("edit").alias("digests")))
    one = rows.select("block", "pos", "ghost", *extra, F.explode(both).alias("v"))
    return one.select("block", "pos", "ghost", *extra, "v.which", F.col("v.digests").alias("of")).where("of IS NOT NULL")


def _subtracted(rows: DataFrame, cells: int, first: bool, tasks: int) -> DataFrame:
    """The sketches of each pair, subtracted."""
    dealt = rows.repartition(tasks, "block")
    versions = _versions(dealt, []) if first else dealt
    keys = ["block", "pos", "ghost", "which"] + ([] if first else ["enters"])
    held = sketch(versions, keys, "of", cells).withColumn("enter", F.explode(_contributions(first)))
    held = held.select("block", "enter.pair", "enter.side", "cell", (F.col("held") * F.col("enter.sign")).alias("held"), "digests", "checks")
    return held.groupBy(*PAIR, "cell").agg(
        F.sum("held").alias("held"), F.bit_xor("digests").alias("digests"), F.bit_xor("checks").alias("checks")
    )


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The versions that failed pairs are made of, each with the differences it enters."""
    entry = lambda sign: F.struct("pair", "side", F.lit(sign).cast("long").alias("sign")).alias("entry")
    firsts = pairs.select("block", F.col("pair").alias("pos"), F.lit(0).alias("which"), entry(1))
    edits = pairs.where("side = 0").select("block", F.col("pair").alias("pos"), F.lit(1).alias("which"), entry(-1))
    nexts = pairs.where("side = 1").select("block", (F.col("pair") + 1).alias("pos"), F.lit(0).alias("which"), entry(-1))
    enters = firsts.union(edits).union(nexts).groupBy("block", "pos", "which").agg(F.sort_array(F.collect_list("entry")).alias("enters"))  # at most three
    return materialise(_versions(rows, []).join(enters, ["block", "pos", "which"]), "retry")


def _prints(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows with the fingerprints of their text and edited text, and the number of paragraphs of each."""
    dealt = rows.where("NOT ghost").repartition(tasks, "block")
    versions = _versions(dealt, [])
    keys = ["block", "pos", "which"]
    prints = printed(sketch(versions, keys, "of", PRINTED), keys)
    by_row = prints.groupBy("block", "pos").agg(
        F.max(F.when(F.col("which") == 0, F.col("print"))).alias("p0"), F.max(F.when(F.col("which") == 1, F.col("print"))).alias("p1")
    )
    joined = dealt.join(by_row, ["block", "pos"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        "block", "pos", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), empty("p0").alias("fingerprint"), empty("p1").alias("edited_fingerprint")
    )
