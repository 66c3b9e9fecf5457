"""Hard negatives by coordinate pruning over length buckets.

Vectors are laid out by label and falling length in range partitions of about
``PART_ROWS`` rows. A task cuts its rows into buckets of one label and of alike
lengths, and sorts a bucket's unit vectors by a coordinate when first asked.
For an anchor q and a score that a row must reach, the bucket's greatest length
gives the cosine t to reach; coordinate f of a unit vector with that cosine lies
within cos(acos(q_f) +- acos(t)). The ranges of the anchor's ``FOCUS`` greatest
coordinates, found in the sorted lists, are intersected, and only rows in all
of them are multiplied out. A bucket too short for t is left at once. Anchors
whose narrowest range still holds half the bucket are multiplied out together.

Anchors are taken in groups of about ``GROUP``; a group is all that a task or
the driver holds of them, and the table of rows is scanned, never shuffled, for
each group. A first search over one row in ``SEEDS`` gives every request a score
that its result reaches for certain; it only lowers the number of rows that
tasks report, which are merged in Spark. Results are exact.

A row with a null label, a null vector or a null or non-finite component takes
no part. Components are floor(256 x), held within +-2^25; a missing component of
a shorter vector counts as 0. Null ids are never anchors and come last in ties.
Repeated rows are rows of their own: a copy of an anchor is one of its other
rows, and a repeated anchor is answered each time. Empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.session import cut_lineage, literal_rows

SCALE = 256
LIMIT = 1 << 25
PART_ROWS = 1 << 12
BUCKET = 1 << 11
LENGTH_RATIO = 0.9
FOCUS = 5
GROUP = 1 << 13
SEEDS = 64
CELLS = 1 << 21
SLACK = 1e-9
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "request int, score long, vec_id long, row long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(embedding: str = "embedding"):
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & F.coalesce(fine, F.lit(False))


def prepared(rows: DataFrame, shift: int = 7, labels: int = 10) -> DataFrame:
    """(row, vec_id, label, x, length): integer vectors of the rows that take part, written once."""
    bound = lambda c: F.greatest(F.least(c, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    whole = F.transform("embedding", lambda c: F.floor(bound(c.cast("double") * SCALE)).cast("int"))
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    kept = rows.where(F.col("label").isNotNull() & usable()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), moved.cast("long").alias("label"), whole.alias("x")
    )
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return cut_lineage(kept.withColumn("length", F.sqrt(square)))


def laid_out(rows: DataFrame, count: int) -> DataFrame:
    """Rows in range partitions by label and falling length; a length that many share is cut by row."""
    order = ["label", F.desc("length"), "row"]
    return cut_lineage(rows.repartitionByRange(max(1, -(-count // PART_ROWS)), *order).sortWithinPartitions(*order))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` numbers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Requests:
    """A bounded group of anchors and, for each request, its anchor and the scores that count.

    ``same`` asks for rows of the anchor's label, otherwise for rows of other labels.
    """

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def __post_init__(self):
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


class Bucket:
    """Rows of one label and alike lengths, with sorted coordinate lists."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.row = batch.column("row").to_numpy()
        self.vec_id = batch.column("vec_id")
        self.label = batch.column("label")[0].as_py()
        self.x = matrix(batch.column("x"), width)
        length = batch.column("length").to_numpy()
        self.longest = float(length.max())
        self.unit = self.x / np.maximum(length, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows within the feasible range of every focus coordinate; None if no range prunes half the bucket."""
        q = unit[focus]
        spread = np.sqrt((1 - cosine * cosine) * np.maximum(0.0, 1 - q * q))
        low = np.where(q >= -cosine, q * cosine - spread, -1.0) - SLACK
        high = np.where(q <= cosine, q * cosine + spread, 1.0) + SLACK
        spans = [(*np.searchsorted(self.coordinate(f)[1], (a, b)), f) for f, a, b in zip(focus, low, high)]
        start, stop, f = min(spans, key=lambda s: s[1] - s[0])
        if 2 * (stop - start) > len(self.row):
            return None
        chosen = self.coordinate(f)[0][start:stop]
        values = self.unit[chosen[:, None], focus]
        return chosen[((values >= low) & (values <= high)).all(axis=1)]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers; by floating point where that is exact."""
    reach = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if reach < 1 << 53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def buckets(batch: pa.RecordBatch, width: int) -> Iterator[Bucket]:
    """Cut sorted rows at a change of label, a fall of the length, or BUCKET rows."""
    label, length = batch.column("label").to_numpy(), batch.column("length").to_numpy()
    edges = np.append(np.flatnonzero(np.diff(label)) + 1, len(label))
    start = 0
    for end in edges.tolist():
        while start < end:
            alike = int(np.searchsorted(-length[start:end], -LENGTH_RATIO * length[start], "right"))
            stop = min(start + max(alike, 1), start + BUCKET, end)
            yield Bucket(batch.slice(start, stop - start), width)
            start = stop


def _met(q: Requests, low: np.ndarray, bucket: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(request, score, place in the bucket) of rows that still count for a request."""
    asked = np.flatnonzero((q.label[q.anchor] == bucket.label) == q.same)
    if not len(asked):
        return
    least = np.full(len(q.row), np.inf)
    np.minimum.at(least, q.anchor[asked], low[asked].astype(float))
    reach = q.length * bucket.longest
    cosine = np.where(least > 0, least / np.maximum(reach, 1e-300) - SLACK, -1.0)
    open_ = np.isfinite(least) & (cosine <= 1)
    together, alone = [], {}
    for a in np.flatnonzero(open_).tolist():
        found = bucket.candidates(q.unit[a], q.focus[a], cosine[a]) if cosine[a] > 0 else None
        if found is None:
            together.append(a)
        elif len(found):
            alone[a] = found
    every = np.arange(len(bucket.row))
    of = {a: [] for a in (*together, *alone)}
    for r in asked.tolist():
        if q.anchor[r] in of:
            of[q.anchor[r]].append(r)
    step = max(1, CELLS // len(every))
    blocks = [(together[i : i + step], every) for i in range(0, len(together), step)]
    for anchors, places in [*blocks, *(([a], p) for a, p in alone.items())]:
        scores = product(q.x[anchors], bucket.x[places])
        requests = np.array([r for a in anchors for r in of[a]])
        line = np.repeat(np.arange(len(anchors)), [len(of[a]) for a in anchors])
        for i in range(0, len(requests), step):
            some = requests[i : i + step]
            values = scores[line[i : i + step]]
            counts = (values >= low[some, None]) & (values <= q.high[some, None])
            if q.same:
                counts &= bucket.row[places][None, :] != q.row[q.anchor[some], None]
            at, place = np.nonzero(counts)
            yield some[at], values[at, place], places[place]


def _best(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k first of every request: by falling score, rising id (missing ids last), row."""
    request, score, vec_id, row = held
    order = np.lexsort((row, vec_id, -score, request))
    request = request[order]
    first = np.searchsorted(request, request)
    kept = order[np.arange(len(order)) - first < k]
    return [c[kept] for c in held]


def _searching(q: Requests, width: int):
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = q.low.copy()
        held = [np.zeros(0, np.int64) for _ in range(4)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for bucket in buckets(batch, width):
                ids = bucket.vec_id.fill_null(none).to_numpy()
                for request, score, place in _met(q, low, bucket):
                    new = (request, score, ids[place], bucket.row[place])
                    held = _best([np.concatenate(pair) for pair in zip(held, new)], q.k)
                    counts = np.bincount(held[0], minlength=len(low))
                    last = np.cumsum(counts) - 1
                    full = np.flatnonzero(counts == q.k)
                    low[full] = held[1][last[full]]
        request, score, vec_id, row = held
        columns = [pa.array(request.astype(np.int32)), pa.array(score), pa.array(vec_id, mask=vec_id == none), pa.array(row)]
        yield pa.RecordBatch.from_arrays(columns, ["request", "score", "vec_id", "row"])

    return run


def search(laid: DataFrame, q: Requests, width: int) -> DataFrame:
    """(request, rank, score, vec_id, row): the k first rows of every request among ``laid``."""
    found = laid.select("row", "vec_id", "label", "x", "length").mapInArrow(_searching(q, width), FOUND)
    order = Window.partitionBy("request").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= q.k)


def seeded(laid: DataFrame, q: Requests, width: int) -> DataFrame:
    """``search``, after a search over one row in SEEDS has raised the scores to reach."""
    some = laid.where(F.pmod(F.xxhash64("row"), F.lit(SEEDS)) == 0)
    reached = search(some, q, width).where(F.col("rank") == q.k).select("request", "score").toArrow()
    q.low[reached.column("request").to_numpy()] = reached.column("score").to_numpy()
    return search(laid, q, width)


def mine(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100
) -> DataFrame:
    """Hard negatives of every anchor and positive; see RESULT for the columns.

    Anchors are rows whose id is divisible by ``every``. A negative scores from
    ``low_percent`` to ``high_percent`` of the positive's score; positives below
    zero have none, as the bounds cross.
    """
    spark = rows.sparkSession
    known = prepared(rows)
    count, width = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    anchors = known.where(F.col("vec_id") % every == 0)
    groups = -(-anchors.count() // GROUP)
    if not groups:
        return literal_rows(spark, [], RESULT)
    laid = laid_out(known, count)
    parts = []
    for g in range(groups):
        group = anchors.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("row", "vec_id", "label", "x").toArrow()
        own = [group.column(c).to_numpy() for c in ("row", "vec_id", "label")]
        n = len(own[0])
        if not n:
            continue
        x = matrix(group.column("x"), width)
        ask = Requests(own[0], own[2], x, np.arange(n), np.full(n, LEAST), np.full(n, MOST), True, positives)
        near = seeded(laid, ask, width).select("request", "vec_id", "score").toArrow().to_pylist()  # at most 5 rows an anchor
        # Positives of one anchor with equal scores share a request.
        wanted = sorted({(r["request"], r["score"]) for r in near if r["score"] >= 0})
        if not wanted:
            continue
        number = {pair: i for i, pair in enumerate(wanted)}
        anchor = np.array([a for a, _ in wanted])
        low, high = (np.array(c) for c in zip(*((-(-low_percent * s // 100), high_percent * s // 100) for _, s in wanted)))
        found = seeded(laid, Requests(own[0], own[2], x, anchor, low, high, False, negatives), width)
        pairs = [(number[r["request"], r["score"]], int(own[1][r["request"]]), r["vec_id"], r["score"]) for r in near if r["score"] >= 0]
        asked = literal_rows(spark, pairs, "request int, anchor_id long, positive_id long, positive_score long")
        answers = found.select("request", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        joined = asked.join(answers, "request")
        columns = ["anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"]
        parts.append(cut_lineage(joined.select(*columns)))
    return reduce(DataFrame.unionByName, parts) if parts else literal_rows(spark, [], RESULT)
