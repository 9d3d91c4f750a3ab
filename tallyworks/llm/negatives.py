"""Hard negatives for anchors: lists shared by clusters of anchors, walked until no later entry can count.

Anchors are clustered by angle, those of a label apart where labels are few. For a cluster with centre ``c`` whose
members lie within the angle ``t`` of it, a candidate at the angle ``s`` from ``c`` has with a member ``a`` an inner
product of at most ``|a| * |v| * cos(max(0, s - t))``. A part of the table lists its candidates once per cluster by
``|v| * cos(max(0, s - t))``. While members lack entries the list is sorted and walked from the top, in steps that
grow; once they have them, their bars say at once which candidates of a list can count. Clusters that most of a list
can count for are multiplied with all of it together. What the parts found is merged per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise

# Anchors handled in one pass over the table; their vectors are broadcast. More anchors, more passes.
ANCHORS_A_PASS = 8192
# Members of a cluster, about; and the rounds of the clustering.
MEMBERS, ROUNDS, SEED = 32, 8, 0
# More labels than these are clustered together.
LABELS_APART = 64
# List entries that members are first multiplied with, how much more each time, and at most.
STEP, GROWTH, LONGEST_STEP = 256, 4, 4096
# Members and candidates multiplied at a time where most of a list can count: products that stay in a core's cache.
TILE = (512, 2048)
# Clusters whose keys are held at a time.
KEYED = 32
# Candidates listed at a time, and bytes of their vectors.
LISTED, LISTED_BYTES = 32768, 1 << 25
# Tasks of a scan for each core.
TASKS_A_CORE = 3
# Norms from here on could make a score that no long holds.
LARGEST_NORM = float(1 << 31)
# What rounding may take from a cosine; products of whole numbers below 2^53 are exact as doubles, below 2^24 as floats.
SLACK, EXACT, EXACT_SINGLE = 1e-6, float(1 << 53), float(1 << 24)
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
# The score of a place that nothing was found for; its negative is a long too.
NONE = -MOST


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector, norm): the rows that take part, one for each id.

    Left out are rows with a null id, label, vector or component, and those of a norm of 2^31 or more
    (NaN and infinity with them), whose scores no long could hold. Of rows repeated for an id the least by
    label and vector counts.
    """
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.where(F.col("norm") < LARGEST_NORM)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector", "norm")).alias("r")).select("id", "r.label", "r.vector", "r.norm")


def as_bytes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vector) with each vector as the bytes of its doubles, which pass to Python without a look at each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch["vector"].flatten().to_numpy(zero_copy_only=False), batch["vector"].offsets.to_numpy()
            held, cuts = memoryview(flat.astype("<f8").tobytes()), (8 * (offsets.astype(np.int64) - offsets[0])).tolist()
            vectors = pa.array([held[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], vectors], ["id", "label", "vector"])

    return rows.select("id", "label", "vector").mapInArrow(packed, "id long, label long, vector binary")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros, longer ones cut where no anchor has a component."""
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1].astype(np.int64) // 8
    data = vectors.buffers()[2]
    flat = (np.frombuffer(data, "<f8", count=data.size // 8) if data else np.empty(0))[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    inside = col < width
    out[row[inside], col[inside]] = flat[inside]
    return out


def directions(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def clusters(vectors: np.ndarray, members: int = MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length 1 and the cluster of every vector, by spherical k-means from a seeded start."""
    unit = directions(vectors)
    k = max(1, len(unit) // members)
    centres = unit[np.sort(np.random.default_rng(SEED).choice(len(unit), k, replace=False))]
    of = np.zeros(len(unit), dtype=np.int64)
    for _ in range(ROUNDS):
        of = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        full = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(full[:, None], directions(sums), centres)
    return centres, np.argmax(unit @ centres.T, axis=1)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class Anchors:
    """Anchors of one pass in the order of their clusters; each cluster's members, widest angle, and group.

    The anchors of a group have one label where labels are few, else all are one group.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray = field(init=False)
    centres: np.ndarray = field(init=False)
    of: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    widest: np.ndarray = field(init=False)
    # (label or None, first cluster, cluster after the last)
    groups: list[tuple[int | None, int, int]] = field(init=False)

    def __post_init__(self):
        known, which = np.unique(self.labels, return_inverse=True)
        if len(known) > LABELS_APART:
            known, which = [None], np.zeros(len(self.ids), dtype=np.int64)
        of, centres, self.groups, n = np.zeros(len(self.ids), dtype=np.int64), [], [], 0
        for g, label in enumerate(known):
            mine = np.flatnonzero(which == g)
            some, place = clusters(self.vectors[mine])
            of[mine] = n + place
            centres.append(some)
            self.groups.append((None if label is None else int(label), n, n + len(some)))
            n += len(some)
        order = np.argsort(of, kind="stable")
        self.ids, self.labels, self.vectors, self.of = self.ids[order], self.labels[order], self.vectors[order], of[order]
        self.centres, self.first = np.concatenate(centres), np.searchsorted(self.of, np.arange(n + 1))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        own = angles(np.einsum("ij,ij->i", directions(self.vectors), self.centres[self.of]))
        self.widest = np.zeros(n)
        np.maximum.at(self.widest, self.of, own)


@dataclass
class Wanted:
    """Searches of one pass: an anchor's place, whether its own label is wanted, the scores between which it looks, and how many it wants."""

    anchor: np.ndarray
    same_label: bool
    low: np.ndarray
    high: np.ndarray
    most: int


class Found:
    """The ``most`` best (score, id) of every search so far: higher scores first, then smaller ids."""

    def __init__(self, wanted: Wanted):
        self.most = wanted.most
        n = len(wanted.anchor)
        self.score, self.id = np.full((n, self.most), NONE), np.full((n, self.most), MOST)
        # Searches by anchor.
        self.order = np.argsort(wanted.anchor, kind="stable")
        # Where products are put: fresh memory for each would take longer than they do.
        self.space, self.room = np.empty(TILE[0] * LONGEST_STEP), np.empty(KEYED * LISTED)
        self.marks = np.empty(TILE[0] * LONGEST_STEP + 8, dtype=bool)

    @property
    def bar(self) -> np.ndarray:
        """The score that an entry must reach to count; NONE while a search is not full."""
        return self.score[:, -1]

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Only what these searches have is merged anew."""
        if not len(search):
            return
        mine, place = np.unique(search, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(mine)), self.most), place])
        score, ids = np.concatenate([self.score[mine].ravel(), score]), np.concatenate([self.id[mine].ravel(), ids])
        order = np.lexsort((ids, -score, place))
        starts = np.searchsorted(place[order], np.arange(len(mine)))
        best = order[starts[:, None] + np.arange(self.most)]
        self.score[mine], self.id[mine] = score[best], ids[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search, score and id of each entry."""
        search, place = np.nonzero(self.score != NONE)
        return search, self.score[search, place], self.id[search, place]


class Walk:
    """One list of candidates, and what the searches find in it."""

    def __init__(self, anchors: Anchors, wanted: Wanted, found: Found, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        by_label = np.argsort(labels, kind="stable")
        self.anchors, self.wanted, self.found, self.products = anchors, wanted, found, 0
        self.ids, self.labels, vectors = ids[by_label], labels[by_label], vectors[by_label]
        self.norms = np.linalg.norm(vectors, axis=1)
        self.units, self.longest = vectors / np.where(self.norms == 0, 1, self.norms)[:, None], self.norms.max(initial=0)
        self.alike = self.norms.min(initial=np.inf) > 0.9 * self.longest
        # Of each anchor the first of its searches by anchor, and the one after its last.
        self.searches = np.searchsorted(wanted.anchor[found.order], np.arange(len(anchors.ids) + 1))
        largest = max(self.longest, 1) * max(anchors.norms.max(initial=0), 1)
        whole = largest < EXACT_SINGLE / 2 and (vectors == np.rint(vectors)).all() and (anchors.vectors == np.rint(anchors.vectors)).all()
        self.kind = np.float32 if whole else np.float64 if largest < EXACT else np.int64
        self.limit = {np.float32: int(EXACT_SINGLE), np.float64: int(EXACT), np.int64: MOST}[self.kind]
        self.vectors, self.members = vectors.astype(self.kind), anchors.vectors.astype(self.kind)

    def of(self, first: int, last: int) -> np.ndarray:
        """The searches of anchors that can still find something."""
        mine = self.found.order[self.searches[first] : self.searches[last]]
        return mine[self.wanted.low[mine] <= self.wanted.high[mine]]

    def need(self, mine: np.ndarray) -> np.ndarray:
        return np.maximum(self.found.bar[mine], self.wanted.low[mine])

    def least_key(self, mine: np.ndarray) -> float:
        """What a candidate's key must reach to count for one of these searches."""
        norms, need = self.anchors.norms[self.wanted.anchor[mine]], self.need(mine) - SLACK
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(norms > 0, need / norms, np.where(need <= 0, -np.inf, np.inf))
        return float(each.min(initial=np.inf))

    def keys(self, c: int, cos: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The keys of candidates by the cosine of ``s``: ``cos(s - t)`` where ``s`` is beyond ``t``, else 1."""
        t, cos = self.anchors.widest[c], np.clip(cos, -1, 1)
        beyond = cos * np.cos(t) + np.sqrt(1 - cos * cos) * np.sin(t)
        return self.norms[cols] * np.minimum(np.where(cos >= np.cos(t), 1, beyond) + SLACK, 1 + SLACK)

    def least_cosine(self, c: int, key: float) -> float:
        """What the cosine of ``s`` must reach for a candidate of the list's largest norm to have this key."""
        if not self.longest or key == np.inf:
            return -np.inf if key <= 0 else np.inf
        share = key / self.longest - SLACK
        if share > 1 or share <= -1:
            return np.inf if share > 1 else -np.inf
        return np.cos(min(np.pi, self.anchors.widest[c] + np.arccos(share))) - SLACK / 1000

    def multiply(self, rows: np.ndarray, cols: np.ndarray | slice) -> None:
        """Adds to what is found the products of these anchors and candidates, of which there are at most ``LONGEST_STEP``."""
        for at in range(TILE[0], len(rows), TILE[0]):
            self.multiply(rows[at : at + TILE[0]], cols)
        rows = rows[: TILE[0]]
        wanted, first = self.wanted, self.searches[rows]
        n = self.searches[rows + 1] - first
        members, vectors = self.members[rows], self.vectors[cols]
        shape, size = (len(members), len(vectors)), len(members) * len(vectors)
        scores = np.matmul(members, vectors.T, out=self.found.space.view(self.kind)[:size].reshape(shape))
        if self.kind is np.float64:
            np.rint(scores, out=scores)
        self.products += size
        # By search, and the least that one of an anchor's searches needs.
        of = np.repeat(np.arange(len(rows)), n)
        search = self.found.order[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        need = np.where(wanted.low[search] <= wanted.high[search], self.need(search), MOST)
        least = np.full(len(rows), MOST)
        np.minimum.at(least, of, need)
        bars = np.clip(least, -self.limit, self.limit).astype(self.kind)[:, None]
        marks = self.found.marks
        np.greater_equal(scores, bars, out=marks[:size].reshape(shape))
        # Few are set: eight are looked at as one number.
        whole = -(-size // 8) * 8
        marks[size:whole] = False
        set_in = np.flatnonzero(marks[:whole].view(np.uint64))
        at, place = np.nonzero(marks[:whole].reshape(-1, 8)[set_in])
        at = 8 * set_in[at] + place
        if not len(at):
            return
        score = scores.ravel()[at].astype(np.int64)
        row, col = np.divmod(at, scores.shape[1])
        labels, ids = self.labels[cols][col], self.ids[cols][col]
        same = self.anchors.labels[rows][row] == labels
        right = same & (self.anchors.ids[rows][row] != ids) if wanted.same_label else ~same
        row, score, ids = row[right], score[right], ids[right]
        # Every search of a row's anchor.
        starts = np.r_[0, np.cumsum(n)]
        each = np.repeat(np.arange(len(row)), n[row])
        place = np.arange(len(each)) - np.repeat(np.cumsum(n[row]) - n[row], n[row]) + starts[row][each]
        right = (score[each] >= need[place]) & (score[each] <= wanted.high[search[place]])
        each, place = each[right], place[right]
        self.found.add(search[place], score[each], ids[each])

    def grown(self, rows: np.ndarray, mine: np.ndarray, cols: np.ndarray, key: np.ndarray) -> None:
        """From the highest key on, until none that follows can count."""
        order = np.argsort(-key, kind="stable")
        at, step = 0, STEP
        while at < len(order) and key[order[at]] >= self.least_key(mine):
            self.multiply(rows, cols[order[at : at + step]])
            at, step = at + step, min(step * GROWTH, LONGEST_STEP)

    def group(self, label: int | None, first: int, last: int) -> None:
        """All clusters of a group."""
        anchors, start, stop = self.anchors, 0, len(self.labels)
        a, b = (stop, stop) if label is None else np.searchsorted(self.labels, [label, label + 1]) if label < MOST else (np.searchsorted(self.labels, label), stop)
        if label is not None and self.wanted.same_label:
            start, stop, a, b = a, b, b, b
        # The candidates are those from ``start`` to ``stop`` but for ``a`` to ``b``.
        if stop - start == b - a:
            return
        most = []
        for c in range(first, last):
            if (c - first) % KEYED == 0:
                centres = anchors.centres[c : min(c + KEYED, last)]
                shape = (len(centres), stop - start)
                room = self.found.room[: shape[0] * shape[1]].reshape(shape) if shape[0] * shape[1] <= len(self.found.room) else None
                cosines = np.matmul(centres, self.units[start:stop].T, out=room)
            cos = cosines[(c - first) % KEYED]
            mine = self.of(anchors.first[c], anchors.first[c + 1])
            if not len(mine):
                continue
            rows, key = np.arange(anchors.first[c], anchors.first[c + 1]), self.least_key(mine)
            if (self.found.bar[mine] == NONE).any():
                cols = np.r_[start:a, b:stop]
                self.grown(rows, mine, cols, self.keys(c, cos[cols - start], cols))
                continue
            can = cos >= self.least_cosine(c, key)
            if 2 * np.count_nonzero(can) > len(can) and not self.alike:
                can &= self.keys(c, cos, slice(start, stop)) >= key
            if 2 * np.count_nonzero(can) > len(can):
                most.append(rows)
                continue
            can[a - start : b - start] = False
            cols = np.flatnonzero(can) + start
            cols = cols[self.keys(c, cos[cols - start], cols) >= key]
            for at in range(0, len(cols), LONGEST_STEP):
                self.multiply(rows, cols[at : at + LONGEST_STEP])
        rows = np.concatenate(most) if most else np.empty(0, dtype=np.int64)
        for run in (range(start, a), range(b, stop)) if len(rows) else ():
            for col in run[:: TILE[1]]:
                self.multiply(rows, slice(col, min(col + TILE[1], run.stop)))


def walk(anchors: Anchors, wanted: Wanted, found: Found, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
    """Adds to ``found`` what the searches find among these candidates; the number of products it took.

    Exact: an entry is passed over only where its bound, or that of an entry before it, is below the bar
    of the search or below its lowest score.
    """
    one = Walk(anchors, wanted, found, ids, labels, vectors)
    for group in anchors.groups:
        one.group(*group)
    return one.products


def shares(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole score within ``low`` and ``high`` per cent of each; none below zero."""
    whole = scores.astype(object)
    return (-(-whole * low // 100)).astype(np.int64), (whole * high // 100).astype(np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches taken together, up to ``LISTED`` rows or ``LISTED_BYTES``."""
    held, n, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, LISTED):
            some = batch.slice(at, LISTED)
            if held and (n + some.num_rows > LISTED or size + some.nbytes > LISTED_BYTES):
                yield held
                held, n, size = [], 0, 0
            held, n, size = [*held, some], n + some.num_rows, size + some.nbytes
    if held:
        yield held


def _searched(rows: DataFrame, anchors: Anchors, wanted: Wanted) -> DataFrame:
    """(search, score, id): the best of every search over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, wanted))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, wanted = sent.value
        found, width = Found(wanted), anchors.vectors.shape[1]
        for some in _lists(batches):
            ids, labels = (np.concatenate([b[c].to_numpy() for b in some]) for c in ("id", "label"))
            walk(anchors, wanted, found, ids, labels, np.concatenate([matrix(b["vector"], width) for b in some]))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in found.entries()], ["search", "score", "id"])

    # Every task returns its best of every search, so there are no more tasks than keep all cores busy.
    tasks = rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    partial = tasks.select("id", "label", "vector").mapInArrow(parts, "search long, score long, id long")
    best = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted.most)


def _blocks(rows: DataFrame, is_anchor: Column, a_pass: int) -> Iterator[Anchors]:
    """The anchors, dealt by a hash of their id into blocks of about ``a_pass``."""
    chosen = materialise(rows.where(is_anchor), "anchors")
    n = chosen.count()
    blocks = -(-n // a_pass)
    for b in range(blocks):
        table = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "label", "vector").toArrow().sort_by("id")
        if not table.num_rows:
            continue
        vectors = table["vector"].combine_chunks()
        width = max(map(len, vectors.to_pylist())) // 8
        yield Anchors(table["id"].to_numpy(), table["label"].to_numpy(), matrix(vectors, width))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(
    rows: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    a_pass: int = ANCHORS_A_PASS,
) -> DataFrame:
    """Hard negatives of every pair of an anchor and one of its ``positives`` nearest rows of its label.

    A row's score is its inner product with the anchor; components must be whole numbers. Higher scores
    come first, ties by smaller id. Returned for a pair are the first ``negatives`` rows of another label
    whose score is at least ``low`` and at most ``high`` per cent of the positive's, with their rank from 1;
    no row for a pair without any. ``is_anchor`` is a condition on ``id`` and ``label``.

    Rows that take no part, and rows repeated for an id: see ``usable``. A vector shorter than another
    counts as filled up with zeros. Anchors go through in blocks of about ``a_pass``, each block's vectors
    in one broadcast; a block scans the table twice and shuffles only what was found.
    """
    spark = rows.sparkSession
    rows = materialise(as_bytes(usable(rows, id_col, vector_col, label_col)), "vectors")
    out = None
    for anchors in _blocks(rows, is_anchor, a_pass):
        n = len(anchors.ids)
        every = Wanted(np.arange(n), True, np.full(n, LEAST), np.full(n, MOST), positives)
        near = _searched(rows, anchors, every).orderBy("search", "rank").toArrow()
        of, positive, score = (near[c].to_numpy() for c in ("search", "id", "score"))
        wanted = Wanted(of, False, *shares(score, low, high), negatives)
        best = _searched(rows, anchors, wanted)
        # As many rows as the block has pairs.
        pairs = spark.createDataFrame(
            pa.table({"search": pa.array(np.arange(len(of))), "anchor_id": pa.array(anchors.ids[of]), "positive_id": pa.array(positive), "positive_score": pa.array(score)})
        )
        made = best.join(F.broadcast(pairs), "search").select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        made = materialise(made, "negatives")
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], SCHEMA) if out is None else out
