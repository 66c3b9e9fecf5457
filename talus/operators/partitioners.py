"""Partitioning rules over a (idx, n) unit table and their worker loads.

Worker counts are parameters, so everything keyed by worker or by cut has a
size known before the data is read; only the unit table grows. Cuts are found
by equi-joins against the prefix sums, never by comparing every cut with every
unit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.operators.distribution import size_histogram
from talus.operators.prefix import BLOCK_ROWS, cumulative_counts, dense_index, indexed_counts, running_sums
from talus.session import broadcast_if_bounded, cut_lineage, literal_rows


# --------------------------------------------------------------- worker rules
def worker_block(idx: Column, n_units: Column, p: int) -> Column:
    """Worker of a block layout whose cuts are (i * n) div p."""
    return F.floor(((idx + 1) * p - 1) / n_units)


def worker_cyclic(idx: Column, p: Column) -> Column:
    return F.pmod(idx, p)


def worker_block_cyclic(idx: Column, p: Column, chunk: int) -> Column:
    return F.pmod(F.floor(idx / chunk), p)


def loads_by_rule(units: DataFrame, ps: list[int], rule) -> DataFrame:
    """(p, worker, load) of a rule computed row by row; ``rule(idx, p)``.

    Each unit is replicated once per worker count and summed map-side, so the
    shuffle carries one row per task and worker.
    """
    grid = units.withColumn("p", F.explode(F.array(*[F.lit(p).cast("long") for p in ps])))
    return (
        grid.groupBy("p", rule(F.col("idx"), F.col("p")).cast("long").alias("worker"))
        .agg(F.sum("n").alias("load"))
    )


def cyclic_loads(units: DataFrame, ps: list[int]) -> DataFrame:
    return loads_by_rule(units, ps, worker_cyclic)


def block_cyclic_loads(units: DataFrame, ps: list[int], chunk: int) -> DataFrame:
    return loads_by_rule(units, ps, lambda i, p: worker_block_cyclic(i, p, chunk))


# -------------------------------------------------------------- cut positions
MAX_BLOCKS = 1 << 16


@dataclass(frozen=True)
class Span:
    """Where one workload lies on the unit and record axes, and its largest unit."""

    w: str
    lo: int
    n_units: int
    base: int
    total: int
    largest: int


def _statistics(cum: DataFrame) -> list[Column]:
    zero = F.lit(0).cast("long")
    sums = [(F.min("idx"), "lo"), (F.count(F.lit(1)), "n"), (F.min("cs_prev"), "base"), (F.sum("n"), "total"), (F.max("n"), "largest")]
    return [F.coalesce(value, zero).alias(name) for value, name in sums]


class Workload:
    """Prefix sums of one unit table with its totals as plain numbers.

    The prefix sums are read by every stage of a cut, so they are written once.
    """

    keys: tuple[str, ...] = ()

    def __init__(self, units: DataFrame, key: str | None = None):
        """``units`` is (idx, n) with a dense idx, or (key, n) in key order."""
        self._take(cut_lineage(indexed_counts(units, key) if key else cumulative_counts(units)))
        row = self.cum.agg(*_statistics(self.cum)).first()
        self.spans = [Span("", *row)]

    def _take(self, cum: DataFrame) -> None:
        self.spark: SparkSession = cum.sparkSession
        self.cum = cum
        self.units = cum.select("idx", "n")

    @property
    def n_units(self) -> int:
        return sum(s.n_units for s in self.spans)

    @property
    def total(self) -> int:
        return sum(s.total for s in self.spans)

    @property
    def largest(self) -> int:
        return max((s.largest for s in self.spans), default=0)

    def rows(self, values: Callable[[Span], list[tuple]], schema: str) -> DataFrame:
        """Literal rows of every workload, led by its name where there are several."""
        rows = [(s.w, *value) for s in self.spans for value in values(s)]
        return literal_rows(self.spark, rows, f"w string, {schema}").select(*self.keys, *[c.split()[0] for c in schema.split(", ")])

    def boundary_sums(self, cuts: DataFrame, row_bound: int) -> DataFrame:
        """Adds ``cs``, the records before boundary ``cut``, to ``cuts``.

        Few cuts go to the units, few units to the cuts; otherwise both are
        shuffled by the cut.
        """
        start = literal_rows(self.spark, [(0, 0)], "cut bigint, cs bigint")
        sums = self.cum.select((F.col("idx") + 1).alias("cut"), "cs").unionByName(start)
        few = broadcast_if_bounded(cuts, row_bound)
        return sums.join(few, "cut") if few is not cuts else cuts.join(broadcast_if_bounded(sums, self.n_units + 1), "cut")


class Batch(Workload):
    """Several named unit tables laid end to end: each is a segment of the common axes.

    All cuts of all workloads come from one plan; results carry the name ``w``.
    """

    keys = ("w",)

    def __init__(self, sizes: dict[str, tuple[DataFrame, str]]):
        """``sizes`` maps a name to a (key, n) table and the name of its unique integer key."""
        parts = [df.select(F.lit(w).alias("w"), F.col(key).cast("long").alias("key"), "n") for w, (df, key) in sizes.items()]
        rows = reduce(DataFrame.unionByName, parts)
        scanned = running_sums(rows, [F.col("w"), F.col("key")], {"pos": F.lit(1).cast("long"), "cs": F.col("n")})
        self._take(cut_lineage(scanned.selectExpr("w", "pos - 1 AS idx", "n", "cs - n AS cs_prev", "cs")))
        self.spans = [Span(*row) for row in self.cum.groupBy("w").agg(*_statistics(self.cum)).orderBy("w").collect()]  # one row a name


Pairs = list[tuple[int, int]] | Callable[[Span], list[tuple[int, int]]]


def pairs_of(pairs: Pairs, span: Span) -> list[tuple[int, int]]:
    return [(int(r), int(t)) for r, t in (pairs(span) if callable(pairs) else pairs)]


def part_loads(cuts: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Load between consecutive boundaries of every ``keys`` group."""
    ahead = Window.partitionBy(*keys).orderBy(order)
    return (
        cuts.withColumn("load", F.lead("cs").over(ahead) - F.col("cs"))
        .filter("load IS NOT NULL")
        .select(*keys, F.col(order).alias("worker"), "load")
    )


def _grid(load: Workload, pairs: Pairs) -> DataFrame:
    """(r, t) of every workload with its place on the axes."""
    schema = "r bigint, t bigint, lo bigint, n bigint, total bigint"
    return load.rows(lambda s: [(r, t, s.lo, s.n_units, s.total) for r, t in pairs_of(pairs, s)], schema)


def _row_bound(load: Workload, pairs: Pairs) -> int:
    return sum(r * t + r for s in load.spans for r, t in pairs_of(pairs, s))


def block_cuts_two_stage(load: Workload, pairs: Pairs) -> DataFrame:
    """Boundaries of the equal-count rule: ranks first, threads inside ranks."""
    n = F.col("n")
    parts = _grid(load, pairs).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") * F.col("t"))))
    rank, thread = F.expr("i div t"), F.pmod(F.col("i"), F.col("t"))
    low, high = F.expr("((i div t) * n) div r"), F.expr("((i div t + 1) * n) div r")
    inner = low + F.floor(thread * (high - low) / F.col("t"))
    cut = F.col("lo") + F.when(rank == F.col("r"), n).otherwise(inner)
    return load.boundary_sums(parts.select(*load.keys, "r", "t", "i", cut.cast("long").alias("cut")), _row_bound(load, pairs))


def linspace_cuts(load: Workload, ps: list[int]) -> DataFrame:
    """Boundaries int(j * (n / p)) in double arithmetic, keyed by p."""
    grid = literal_rows(load.spark, [(int(p), load.n_units / p) for p in ps], "p bigint, step double")
    parts = grid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p"))))
    cut = F.when(F.col("i") == F.col("p"), F.lit(load.n_units)).otherwise(F.floor(F.col("i") * F.col("step")))
    return load.boundary_sums(parts.select("p", "i", cut.cast("long").alias("cut")), sum(ps) + len(ps))


def rounded_cuts(load: Workload, ps: list[int]) -> DataFrame:
    """Boundaries int(n * j / p + 0.5): equal counts, each cut rounded to the nearest unit; keyed by p."""
    parts = literal_rows(load.spark, [(int(p),) for p in ps], "p bigint").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p"))))
    cut = F.floor(F.lit(load.n_units) * F.col("i") / F.col("p") + 0.5)
    return load.boundary_sums(parts.select("p", "i", cut.cast("long").alias("cut")), sum(ps) + len(ps))


def _count_below(bounds: str, value: str, size: int) -> Column:
    """How many of at most ``size`` sorted numbers lie below a value, by binary search."""
    steps = [1 << s for s in range(size.bit_length() - 1, -1, -1)]
    if size <= 1:
        return F.lit(0).cast("long")
    probe = lambda at, step: F.get(F.col(bounds), (at + step - 1).cast("int"))
    search = lambda at, step: F.when(probe(at, step) < F.col(value), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s).cast("long") for s in steps]), F.lit(0).cast("long"), search)


def locate(load: Workload, targets: DataFrame, row_bound: int) -> DataFrame:
    """For every target the unit whose interval (cs_prev, cs] holds it: a merge of sorted targets and prefix sums.

    The record axis is cut into cells: blocks of at least BLOCK_ROWS units, at
    most MAX_BLOCKS of them, cut again where many targets fall into one block. A
    cell's units and targets are sorted together by falling value, and a target
    takes the last unit before it; one with no unit above it in its cell takes
    the first unit of the next cell of the block that has one. A target finds
    its block in the sorted block ends, one row of at most MAX_BLOCKS numbers.
    Only units of blocks with a target move. No target meets any other unit, so
    one unit with most of the records, or millions of targets, cost one sort.
    """
    width = max(BLOCK_ROWS, -(-load.n_units // MAX_BLOCKS))
    blocks = max(1, -(-load.n_units // width))
    block = F.floor(F.col("idx") / width).alias("_block")
    units = load.cum.filter("n > 0").select(block, F.col("idx").alias("unit"), "cs_prev", "cs")
    if blocks == 1:
        asked = targets.withColumn("_block", F.lit(0).cast("long"))
    else:
        ends = load.cum.groupBy(block).agg(F.max("cs").alias("_end")).agg(F.sort_array(F.collect_list("_end")).alias("_ends"))  # one row
        asked = targets.crossJoin(F.broadcast(ends)).withColumn("_block", _count_below("_ends", "target", blocks)).drop("_ends")
        units = units.join(broadcast_if_bounded(asked.select("_block").distinct(), blocks), "_block", "left_semi")
    hit = ("unit", "cs_prev", "cs")
    units = units.select(F.col("cs").cast("double").alias("target"), *hit, "_block")
    both = units.unionByName(asked, allowMissingColumns=True)
    parts = row_bound // BLOCK_ROWS + 1
    cell = ["_block"]
    if parts > 1:
        cell = ["_block", "_cell"]
        both = both.withColumn("_cell", F.floor(F.col("target") / max(1, -(-load.total // parts))))
    down = Window.partitionBy(*cell).orderBy(F.desc("target"), F.col("cs").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.select("*", *[F.last(c, ignorenulls=True).over(down).alias(f"_{c}") for c in hit]).filter("cs IS NULL")
    own = [F.col(c) for c in targets.columns]
    if parts == 1:  # a block ends in a unit, so every target has met one
        return met.select(*own, *[F.col(f"_{c}").alias(c) for c in hit])
    cells = both.groupBy(*cell).agg(F.min(F.when(F.col("cs").isNotNull(), F.struct("cs", "cs_prev", "unit"))).alias("_first"))
    above = Window.partitionBy("_block").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.last("_first", ignorenulls=True).over(above).alias("_next"))
    joined = met.join(broadcast_if_bounded(cells, blocks + parts + 1), cell)
    return joined.select(*own, *[F.coalesce(f"_{c}", f"_next.{c}").alias(c) for c in hit])


def nearest_cuts(load: Workload, segments: DataFrame, keys: list[str], row_bound: int, rule: str = "strict") -> DataFrame:
    """Cuts at the unit boundaries nearest to equal record shares.

    ``segments`` holds one row per ``keys`` with lo, hi, base, tot and k.
    ``strict`` leaves room for the remaining cuts and never repeats a cut
    while units last; ``monotone`` only forbids going backwards; ``floor``
    takes the boundary below the target without snapping.
    Returns (keys, i, cut, cs) with i = 0..k.
    """
    rows = segments.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))))
    share = (F.col("tot") * F.col("i")).cast("double") / F.col("k")
    rows = rows.select(*keys, "lo", "hi", "k", "i", "tot", (F.col("base").cast("double") + share).alias("target"))
    # the ends of a segment are given, and one without records has no unit to hit: its cuts start at lo
    inner = (F.col("i") > 0) & (F.col("i") < F.col("k")) & (F.col("tot") > 0)
    placed = locate(load, rows.filter(inner), row_bound).unionByName(rows.filter(~inner), allowMissingColumns=True)
    nseg = F.col("hi") - F.col("lo")
    above = F.greatest(F.lit(0), F.least(nseg, F.coalesce(F.col("unit") + 1, F.col("lo")) - F.col("lo")))
    lower_is_nearer = F.abs(F.col("cs_prev") - F.col("target")) <= F.abs(F.col("cs") - F.col("target"))
    if rule == "floor":
        snapped = F.greatest(F.lit(0), above - 1)
    else:
        snapped = F.when((above > 0) & lower_is_nearer, above - 1).otherwise(above)
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    if rule == "strict":
        room = F.greatest(F.lit(0), F.least(snapped, nseg - (F.col("k") - F.col("i"))))
        rising = F.greatest(F.lit(0), F.max(room - F.col("i")).over(so_far)) + F.col("i")
        j = F.when(nseg <= F.col("k"), F.least(F.col("i"), nseg)).otherwise(F.least(rising, nseg))
    else:
        j = F.max(snapped).over(so_far)
    cut = F.when(F.col("i") == 0, F.col("lo")).when(F.col("i") == F.col("k"), F.col("hi")).otherwise(F.col("lo") + j)
    return load.boundary_sums(placed.select(*keys, "i", cut.cast("long").alias("cut")), row_bound)


def whole_segments(load: Workload, ks: Callable[[Span], list[int]] | list[int], key: str) -> DataFrame:
    """Every workload as a segment for each number of parts."""
    schema = f"{key} bigint, lo bigint, hi bigint, base bigint, tot bigint, k bigint"
    asked = lambda s: ks(s) if callable(ks) else ks
    return load.rows(lambda s: [(int(k), s.lo, s.lo + s.n_units, s.base, s.total, int(k)) for k in asked(s)], schema)


def balanced_cuts(load: Workload, ps: list[int], rule: str = "strict") -> DataFrame:
    """One-stage record-balanced cuts, keyed by p."""
    bound = (sum(ps) + len(ps)) * len(load.spans)
    return nearest_cuts(load, whole_segments(load, ps, "p"), [*load.keys, "p"], bound, rule)


def rank_segments(rank_cuts: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Turn rank boundaries into the segments that the thread stage cuts."""
    ahead = Window.partitionBy(*keys, "r").orderBy("i")
    ranges = rank_cuts.select(
        *keys,
        "r",
        F.col("i").alias("rank"),
        F.col("cut").alias("lo"),
        F.lead("cut").over(ahead).alias("hi"),
        F.col("cs").alias("base"),
        (F.lead("cs").over(ahead) - F.col("cs")).alias("tot"),
    ).filter("hi IS NOT NULL")
    return ranges.join(pairs.select(*keys, "r", "t"), [*keys, "r"]).withColumn("k", F.col("t"))


def balanced_cuts_two_stage(load: Workload, pairs: Pairs, rule: str = "strict") -> DataFrame:
    """Record-balanced ranks, then record-balanced threads inside each rank."""
    ranks = lambda s: sorted({r for r, _ in pairs_of(pairs, s)})
    bound = sum(sum(ranks(s)) + len(ranks(s)) for s in load.spans)
    # the rank cuts are read by every branch of the thread stage: write them once
    first = cut_lineage(nearest_cuts(load, whole_segments(load, ranks, "r"), [*load.keys, "r"], bound, rule))
    segments = rank_segments(first, _grid(load, pairs), list(load.keys))
    return nearest_cuts(load, segments, [*load.keys, "r", "t", "rank"], _row_bound(load, pairs), rule)


def imbalance(load: Workload, pairs: Pairs) -> DataFrame:
    """(r, t, p, imb_block, imb_balanced) of every workload: max load over mean load per rule."""
    keys = [*load.keys, "r", "t"]
    worst_block = part_loads(block_cuts_two_stage(load, pairs), keys).groupBy(*keys).agg(F.max("load").alias("_block"))
    balanced = part_loads(balanced_cuts_two_stage(load, pairs), [*keys, "rank"])
    worst_balanced = balanced.groupBy(*keys).agg(F.max("load").alias("_balanced"))
    joined = _grid(load, pairs).join(worst_block, keys).join(worst_balanced, keys)
    p = F.col("r") * F.col("t")
    mean = F.nullif(F.col("total").cast("double") / p, F.lit(0.0))
    return joined.select(*keys, p.alias("p"), (F.col("_block") / mean).alias("imb_block"), (F.col("_balanced") / mean).alias("imb_balanced"))


def load_summary(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Largest load, imbalance and efficiency over all k workers of a group.

    ``loads`` may omit workers without units; ``p`` must be among the keys.
    """
    agg = loads.groupBy(*keys).agg(F.max("load").alias("max_load"), F.sum("load").alias("total"))
    mean = F.col("total") / F.col("p")
    return agg.withColumn("imbalance", F.col("max_load") / F.nullif(mean, F.lit(0.0))).withColumn(
        "efficiency", mean / F.nullif(F.col("max_load").cast("double"), F.lit(0.0))
    )


# ------------------------------------------------------------ size-sorted rule
def block_sorted_loads(load: Workload, ps: list[int]) -> DataFrame:
    """Equal-count blocks over units sorted by size, largest first.

    Ties have equal sizes, so the histogram decides: each size covers a range
    of sorted positions and emits the cuts that fall into its range.
    """
    n, total = load.n_units, load.total
    grid = literal_rows(load.spark, [(int(p), n / p) for p in ps], "p bigint, step double")
    sizes = size_histogram(load.units).select(
        F.col("n"),
        (F.lit(n) - F.col("cf")).alias("above"),
        (F.lit(n) - F.col("cf") + F.col("f")).alias("upto"),
        (F.lit(total) - F.col("cw")).alias("sum_above"),
    )
    spans = sizes.crossJoin(F.broadcast(grid))  # one copy per requested worker count
    first = F.floor(F.col("above") / F.col("step"))
    last = F.ceil(F.col("upto") / F.col("step"))
    cuts = (
        spans.withColumn("i", F.explode(F.sequence(first, F.least(F.col("p"), last))))
        .withColumn("cut", F.when(F.col("i") == F.col("p"), F.lit(n)).otherwise(F.floor(F.col("i") * F.col("step"))))
        .filter("above < cut AND cut <= upto")
        .select("p", "i", (F.col("sum_above") + F.col("n") * (F.col("cut") - F.col("above"))).alias("cs"))
    )
    zero = F.lit(0).cast("long")
    start = grid.select("p", zero.alias("i"), zero.alias("cs"))
    filled = grid.select("p", F.explode(F.sequence(zero + 1, F.col("p"))).alias("i")).join(cuts, ["p", "i"], "left")
    return part_loads(start.unionByName(filled.na.fill(0, ["cs"])), ["p"])


# ----------------------------------------------------------- sequential rules
GREEDY_CHUNK_SIZES = 1_000_000


def deal_copies(loads: np.ndarray, size: int, copies: int) -> np.ndarray:
    """Loads after giving ``copies`` units of one size to the least loaded.

    Dealing one by one picks the ``copies`` smallest values of
    loads[w] + m * size (ties to the lower worker), so the level they reach
    is found by bisection instead of a step per unit.
    """
    if size == 0 or copies == 0:
        return loads
    low, high = int(loads.min()), int(loads.min()) + size * copies
    while low < high:  # largest level with at most `copies` picks below it
        mid = (low + high + 1) // 2
        if int(np.maximum(0, -((loads - mid) // size)).sum()) <= copies:
            low = mid
        else:
            high = mid - 1
    dealt = np.maximum(0, -((loads - low) // size))
    rest = copies - int(dealt.sum())
    if rest:
        at_level = np.flatnonzero((loads <= low) & ((low - loads) % size == 0))
        dealt[at_level[:rest]] += 1
    return loads + dealt * size


def greedy_loads(units: DataFrame, ps: list[int]) -> DataFrame:
    """(p, worker, load) of largest-first dealing to the least-loaded worker.

    The rule is sequential in the size order but only needs the histogram.
    The histogram is written once, numbered from the largest size, and dealt in
    chunks of GREEDY_CHUNK_SIZES sizes with the p loads carried over: no task
    sees more than one chunk, and the number of jobs follows the distinct sizes
    in millions. The dealing itself stays sequential, one task for each p.
    """
    spark = units.sparkSession
    histogram = units.filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    sizes = cut_lineage(dense_index(histogram, [F.desc("n")], "place"))
    order = range(-(-sizes.count() // GREEDY_CHUNK_SIZES))
    state = {int(p): [0] * int(p) for p in ps}
    schema = "p bigint, worker bigint, load bigint"

    def deal(carried: dict[int, list[int]]) -> Callable:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            p = int(key[0])
            loads = np.array(carried[p], dtype=np.int64)
            for size, copies in pdf.sort_values("n", ascending=False)[["n", "f"]].itertuples(index=False):
                loads = deal_copies(loads, int(size), int(copies))
            return pd.DataFrame({"p": p, "worker": np.arange(p), "load": loads})

        return run

    replicas = F.explode(F.array(*[F.lit(int(p)).cast("long") for p in ps]))
    result = None
    for i, b in enumerate(order):
        chunk = sizes.filter(F.floor(F.col("place") / GREEDY_CHUNK_SIZES) == b).select("n", "f")
        result = chunk.withColumn("p", replicas).groupBy("p").applyInPandas(deal(state), schema)
        if i < len(order) - 1:
            carried: dict[int, list[int]] = {}
            for row in result.orderBy("p", "worker").toLocalIterator():
                carried.setdefault(row["p"], []).append(row["load"])
            state = carried
    if result is None:
        rows = [(p, w, 0) for p in state for w in range(p)]
        return spark.createDataFrame(rows, schema)
    return result


# ----------------------------------------------- optimal contiguous partition
class _KnownSums:
    """Prefix sums fetched so far and which gaps between them hide others."""

    def __init__(self, total: int):
        self.points = np.array([0, total], dtype=np.int64)
        self.open_after = np.array([True, False])

    def add(self, spans: list[tuple[int, int]], low: np.ndarray, high: np.ndarray, hidden: np.ndarray) -> None:
        """Merge the fetched buckets of open gaps; only bucket insides stay open."""
        state = dict(zip(self.points.tolist(), self.open_after.tolist()))
        state.update({a: False for a, _ in spans})
        state.update({b: False for b in high.tolist()})
        state.update(zip(low.tolist(), hidden.tolist()))
        self.points = np.array(sorted(state), dtype=np.int64)
        self.open_after = np.array([state[x] for x in self.points.tolist()], dtype=bool)

    def walk(self, cap: int, p: int, optimistic: bool) -> list[int]:
        """Greedy cut positions; pessimistic ones use known sums only."""
        x, path, end = 0, [0], int(self.points[-1])
        for _ in range(p):
            reach = min(x + cap, end)
            at = int(np.searchsorted(self.points, reach, side="right")) - 1
            x = reach if optimistic and self.open_after[at] else int(self.points[at])
            path.append(x)
        return path

    def smallest_cap(self, low: int, high: int, p: int, optimistic: bool) -> int:
        end = int(self.points[-1])
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, p, optimistic)[-1] >= end:
                high = mid
            else:
                low = mid + 1
        return low

    def hidden(self, first: list[int], last: list[int]) -> set[tuple[int, int]]:
        """Open gaps that a cut between two walks may fall into."""
        spans = set()
        for a, b in zip(first, last):
            i = int(np.searchsorted(self.points, a, side="right")) - 1
            j = int(np.searchsorted(self.points, b, side="left"))
            spans |= {(int(self.points[s]), int(self.points[s + 1])) for s in range(i, max(j, i + 1)) if self.open_after[s]}
        return spans


def contiguous_optimal(load: Workload, ps: list[int] | int, points: int = 1 << 18) -> DataFrame:
    """Cuts of the contiguous partition with the smallest largest load, for all worker counts at once.

    A greedy walk for one cap looks at p positions only, so the driver keeps a
    bounded sample of prefix sums, common to all worker counts. Known sums
    bracket each optimal cap from both sides; a round fetches, in one distributed
    pass, finer sums where some cut of a cap in any bracket may fall, until none
    is hidden. The number of rounds follows the records over ``points``, not the
    number of worker counts. The result is exact. Returns (p, i, cut, cs, cap).
    """
    ps = [ps] if isinstance(ps, int) else [int(p) for p in ps]
    total, spark = int(load.total), load.spark
    known = _KnownSums(total)
    spans = [(0, total)] if total else []
    positive = load.cum.filter("n > 0")
    brackets = {p: (max(int(load.largest), -(-total // p)), total) for p in ps}
    paths = {p: (0, [0] * (p + 1)) for p in ps}
    while spans:
        width = max(1, -(-sum(b - a for a, b in spans) // points))
        wanted = literal_rows(spark, spans, "a bigint, b bigint").select(
            "a", "b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))).alias("bucket")
        )
        fetched = (
            positive.withColumn("bucket", F.floor(F.col("cs") / width))
            .join(broadcast_if_bounded(wanted, points + 2 * len(spans)), "bucket")
            .filter("a < cs AND cs < b")
            .groupBy("a", "bucket")
            .agg(F.min("cs").alias("lo"), F.max("cs").alias("hi"), (F.count(F.lit(1)) > 2).alias("hidden"))
            .toPandas()  # at most `points` rows plus the span ends
        )
        known.add(spans, fetched["lo"].to_numpy(), fetched["hi"].to_numpy(), fetched["hidden"].to_numpy())
        found: set[tuple[int, int]] = set()
        for p, (least, most) in list(brackets.items()):
            high = known.smallest_cap(least, most, p, optimistic=False)
            low = known.smallest_cap(least, high, p, optimistic=True)
            hidden = known.hidden(known.walk(low, p, optimistic=False), known.walk(high, p, optimistic=True))
            if hidden:
                brackets[p] = (low, high)
                found |= hidden
            else:
                paths[p] = (low, known.walk(low, p, optimistic=False))
                del brackets[p]
        spans = sorted(found)
    rows = [(p, i, int(x), int(cap)) for p, (cap, path) in paths.items() for i, x in enumerate(path)]
    steps = literal_rows(spark, rows, "p bigint, i bigint, cs bigint, cap bigint")
    ends = load.cum.groupBy("cs").agg((F.max("idx") + 1).alias("cut"))
    asked = broadcast_if_bounded(steps.select("cs").distinct(), len(rows))
    joined = steps.join(ends.join(asked, "cs", "left_semi"), "cs", "left")
    cut = F.when(F.col("i") == 0, F.lit(0)).when(F.col("cs") == total, F.lit(load.n_units)).otherwise(F.coalesce("cut", F.lit(0)))
    return joined.select("p", "i", cut.cast("long").alias("cut"), "cs", "cap")


def scaled_work(work: DataFrame, rho_hundredths: int = 531) -> DataFrame:
    """(idx, n) with n = 100 * records + 531 * whitelisted records.

    Cuts and imbalance do not depend on the scale; integers keep the prefix
    sums exact in any summation order.
    """
    return work.select("idx", (100 * F.col("n") + rho_hundredths * F.col("k")).alias("n"))
