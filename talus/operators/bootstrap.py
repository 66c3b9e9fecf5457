"""Permutation bootstrap of partition efficiency and its analytic forecasts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions.scalars import safe_ratio
from talus.operators.digests import LeadingBits
from talus.operators.quantiles import grouped_quantiles
from talus.session import broadcast_if_bounded, cut_lineage, literal_rows

# Seed, band outside which the canonical order is flagged.
BOOT_SEED = 20260728
FLAG_BAND = (5.0, 95.0)


STRATEGIES = ("block", "cyclic", "nzbalanced")
EXACT = 1 << 53
# Units that one task orders at a time, units of a packed row, units packed together, permutations of a batch of rows.
BLOCK_ROWS = 1 << 20
ROW_UNITS = 1024
PIECE_UNITS = 1 << 16
BATCH_BOOTS = 64
# Blocks of units that a task holds whole and orders for many permutations, without a shuffle.
WHOLE_BLOCKS = 4
PACKED = "b int, block long, first long, units long, total long, idx binary, n binary, cost binary"


def _narrow(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all; their number gives the width back."""
    low, high = int(x.min()), int(x.max())
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _wide(data: bytes, units: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // units}").astype(np.int64)


def _digests(seed: int, b: int, idx: np.ndarray) -> np.ndarray:
    """The leading 128 bits of sha256("seed|b|idx"), as pairs of 64-bit numbers."""
    head, sha = f"{seed}|{b}|".encode(), hashlib.sha256
    return np.frombuffer(b"".join([sha(head + b"%d" % i).digest()[:16] for i in idx.tolist()]), ">u8").astype(np.uint64).reshape(-1, 2)


def _order(seed: int, b: int, idx: np.ndarray) -> np.ndarray:
    """Places of units, given by rising idx, in permutation b; b = 0 is the given order, equal digests go by index."""
    if b == 0:
        return np.arange(len(idx))
    keys = _digests(seed, b, idx)
    order = np.argsort(keys[:, 0], kind="stable")
    high = keys[order, 0]
    return np.lexsort((keys[:, 1], keys[:, 0])) if (high[1:] == high[:-1]).any() else order


def _packing(n_boot: int, seed: int, digits: int, piece_units: int, block_units: int):
    """Units sorted by idx -> packed rows of every permutation: ROW_UNITS units of one block or fewer, sorted by idx."""

    def rows(idx: np.ndarray, n: np.ndarray, cost: np.ndarray) -> list[tuple]:
        out = []
        for i in range(0, len(idx), ROW_UNITS):
            part = slice(i, i + ROW_UNITS)
            gaps = np.diff(idx[part], prepend=idx[i])
            work = b"" if np.array_equal(n[part], cost[part]) else _narrow(cost[part])
            out.append((int(idx[i]), len(gaps), int(n[part].sum()), _narrow(gaps), _narrow(n[part]), work))
        return out

    def packed(idx: np.ndarray, n: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(idx, kind="stable")
        idx, n, cost = idx[order], n[order], cost[order]
        whole = None if digits else rows(idx, n, cost)
        for start in range(0, n_boot + 1, BATCH_BOOTS):
            out = []
            for b in range(start, min(start + BATCH_BOOTS, n_boot + 1)):
                if whole is not None:
                    out += [(b, 0, *row) for row in whole]
                    continue
                block = idx // block_units if b == 0 else (_digests(seed, b, idx)[:, 0] >> np.uint64(64 - 4 * digits)).astype(np.int64)
                for k in np.unique(block):
                    own = block == k
                    out += [(b, int(k), *row) for row in rows(idx[own], n[own], cost[own])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    types = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3]
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("idx", "n", "cost")]
            cuts = np.flatnonzero(np.diff(columns[0] // piece_units)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = tuple(c[i:j] for c in columns)
                if held and len(part[0]) and held[0][0][0] // piece_units != part[0][0] // piece_units:
                    yield from packed(*(np.concatenate(c) for c in zip(*held)))
                    held = []
                if len(part[0]):
                    held.append(part)
        if held:
            yield from packed(*(np.concatenate(c) for c in zip(*held)))

    return run


def permuted(units: DataFrame, n_units: int, n_boot: int, seed: int = BOOT_SEED, digits: int | None = None) -> DataFrame:
    """Units of every permutation b = 0..n_boot, packed and gathered by (b, block); b = 0 is the given order.

    A permutation orders the units by a digest of (seed, b, idx), which the task
    that orders them works out again, so only indexes, records and costs travel,
    in as few bytes as hold them. Where a permutation has more than BLOCK_ROWS
    units it is cut into blocks by the digest's first ``digits`` hexadecimal
    digits, so that no task sorts a whole permutation; ``before`` and
    ``sum_before`` are the units and records of its earlier blocks.
    """
    digits = _digits(n_units) if digits is None else digits
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(units, n_boot, seed, digits)
    zero = F.lit(0).cast("long")
    if digits:
        packed = cut_lineage(packed)  # the digests that cut it are worked out once
        sums = packed.groupBy("b", "block").agg(F.sum("units").alias("_rows"), F.sum("total").alias("_sum"))
        earlier = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        running = [F.coalesce(F.sum(c).over(earlier), zero).alias(name) for c, name in (("_rows", "before"), ("_sum", "sum_before"))]
        bases = sums.select("b", "block", *running)
        blocks = n_boot * 16**digits + n_units // BLOCK_ROWS + 1
        packed = packed.join(broadcast_if_bounded(bases, blocks), ["b", "block"])
    else:
        packed = packed.withColumns({"before": zero, "sum_before": zero})
    return packed.repartition(parts, "b", "block").sortWithinPartitions("b", "block", "first")


def _packed(units: DataFrame, n_boot: int, seed: int, digits: int) -> DataFrame:
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece_units = min(PIECE_UNITS, ROW_UNITS * 16**digits)
    sorted_units = units.repartition(parts, F.floor(F.col("idx") / piece_units)).sortWithinPartitions("idx")
    return sorted_units.mapInArrow(_packing(n_boot, seed, digits, piece_units, BLOCK_ROWS), PACKED)


def _digits(n_units: int) -> int:
    digits = 0
    while n_units > BLOCK_ROWS * 16**digits:
        digits += 1
    return digits


def _added(slots: np.ndarray, cost: np.ndarray, size: int) -> np.ndarray:
    if int(cost.sum()) < EXACT:
        return np.bincount(slots, cost, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, slots, cost)
    return out


def _loads(ps: list[int], n_units: int, records: int):
    """Rows (b, slot, load) of units in their order; ``slot`` numbers (p, rule, worker)."""
    width = len(STRATEGIES) * sum(ps)
    slots = pa.array(np.arange(width, dtype=np.int32))

    def loads(b: int, before: int, sum_before: int, n: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
        place, middle = np.arange(len(n)) + before, np.cumsum(n) + sum_before - n / 2.0
        found = []
        for p in ps:
            # a unit belongs to the part that holds its record midpoint: nearest-boundary cuts
            held = np.minimum(p - 1, np.floor(middle * p / records)).astype(np.int64) if records else np.zeros(len(n), np.int64)
            found += [_added(worker, cost, p) for worker in (((place + 1) * p - 1) // n_units, place % p, held)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(width, b, np.int32)), slots, pa.array(np.concatenate(found))], ["b", "slot", "load"])

    return loads


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, n, cost) of packed rows, by rising idx."""
    idx = np.concatenate([first + np.cumsum(_wide(gaps, units)) for first, units, gaps, _, _ in rows])
    n = np.concatenate([_wide(data, units) for _, units, _, data, _ in rows])
    cost = np.concatenate([_wide(work or data, units) for _, units, _, data, work in rows])
    given = np.argsort(idx, kind="stable")
    return idx[given], n[given], cost[given]


def _dealing_whole(shared, ps: list[int], n_units: int, records: int, seed: int):
    """Loads of every rule and worker for each b, from all units, which a task unpacks once."""
    loads = _loads(ps, n_units, records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, n, cost = _unpacked(shared.value)
        leading = LeadingBits(idx)
        for batch in batches:
            for b in batch.column("b").to_pylist():
                if b:
                    keys = leading(f"{seed}|{b}|")
                    order = np.argsort(keys, kind="stable")
                    ranked = keys[order]
                    tied = np.flatnonzero(ranked[1:] == ranked[:-1])
                    if (idx[order[tied]] != idx[order[tied + 1]]).any():
                        order = _order(seed, b, idx)
                    yield loads(b, 0, 0, n[order], cost[order])
                else:
                    yield loads(b, 0, 0, n, cost)

    return run


def _dealing(ps: list[int], n_units: int, records: int, seed: int):
    """Loads of every rule and worker from packed units, a group at a time."""
    loads = _loads(ps, n_units, records)

    def dealt(b: int, before: int, sum_before: int, rows: list[tuple]) -> pa.RecordBatch:
        idx, n, cost = _unpacked(rows)
        order = _order(seed, b, idx)
        return loads(b, before, sum_before, n[order], cost[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("b", "block", "before", "sum_before")))
            for (b, block, before, sum_before), *row in zip(keys, *(batch.column(c).to_pylist() for c in ("first", "units", "idx", "n", "cost"))):
                if group is not None and group[:2] != (b, block):
                    yield dealt(group[0], *group[2:], rows)
                    rows = []
                group = (b, block, before, sum_before)
                rows.append(tuple(row))
        if rows:
            yield dealt(group[0], *group[2:], rows)

    return run


def efficiencies(units: DataFrame, ps: list[int], n_boot: int, seed: int = BOOT_SEED, cost: str = "n") -> DataFrame:
    """(b, p, strategy, efficiency) for every permutation.

    Units are ordered and cut by their records ``n``; loads add up ``cost``, by
    default the records too; an unknown number counts as 0. Up to WHOLE_BLOCKS
    blocks of units travel once, packed, to every executor, and tasks take permutations;
    beyond, a unit goes through the shuffle once for each permutation, in a few
    bytes. Tasks order units, deal them to all rules and worker counts at once,
    and only loads leave them.
    """
    spark, ps = units.sparkSession, [int(p) for p in ps]
    zero = F.lit(0).cast("long")
    long = lambda c: F.coalesce(F.col(c).cast("long"), zero)
    given = units.select(F.col("idx").cast("long").alias("idx"), long("n").alias("n"), long(cost).alias("cost"))
    n_units, records, whole = given.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("cost"), zero)).first()
    slots = [(p, s) for p in ps for s in STRATEGIES for _ in range(p)]
    names = literal_rows(spark, [(i, *x) for i, x in enumerate(slots)], "slot int, p bigint, strategy string")
    if 0 < n_units <= WHOLE_BLOCKS * BLOCK_ROWS:
        rows = _packed(given, 0, seed, 0).select("first", "units", "idx", "n", "cost").collect()
        rows = sorted((r["first"], r["units"], bytes(r["idx"]), bytes(r["n"]), bytes(r["cost"])) for r in rows)
        shared = spark.sparkContext.broadcast(rows)  # a few bytes a unit
        boots = spark.range(0, n_boot + 1, 1, min(n_boot + 1, 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").cast("int").alias("b"))
        dealt = boots.mapInArrow(_dealing_whole(shared, ps, n_units, records, seed), "b int, slot int, load long")
    else:
        dealt = permuted(given, n_units, n_boot, seed).mapInArrow(_dealing(ps, n_units, records, seed), "b int, slot int, load long")
    loads = dealt.groupBy("b", "slot").agg(F.sum("load").alias("load")).join(broadcast_if_bounded(names, len(slots)), "slot")
    largest = F.nullif(F.max("load"), zero)
    return loads.groupBy("b", "p", "strategy").agg((F.lit(whole) / F.col("p") / largest).alias("efficiency"))


def summarise_bootstrap(eff: DataFrame) -> DataFrame:
    """Spread over permutations and where the given order falls."""
    keys = ["p", "strategy"]
    given = eff.filter("b = 0").select(*keys, F.col("efficiency").alias("canonical"))
    boot = eff.filter("b > 0")
    spread = grouped_quantiles(
        boot, keys, {"p2_5": ("efficiency", 0.025), "p97_5": ("efficiency", 0.975)},
        [F.count(F.lit(1)).alias("n_boot"), F.avg("efficiency").alias("boot_mean"),
         F.stddev_samp("efficiency").alias("boot_sd")],
    )
    below = boot.join(given, keys).groupBy(*keys).agg(
        (100.0 * F.avg((F.col("efficiency") <= F.col("canonical")).cast("double"))).alias("percentile")
    )
    outside = ~F.col("percentile").between(*FLAG_BAND)
    return spread.join(given, keys).join(below, keys).withColumn("flagged", outside)


# -------------------------------------------------------------------- forecasts
def forecast_efficiency(cv: Column, m: Column, p: Column) -> Column:
    """1 / (1 + cv / sqrt(m) * sqrt(2 ln p)): large-p forecast, m units per part."""
    return 1.0 / (1.0 + cv / F.sqrt(m) * F.sqrt(2.0 * F.log(p.cast("double"))))


def expected_max_normal(p: int, steps: int = 20_001, reach: float = 9.0) -> float:
    """Mean of the largest of p standard normals, by integrating 1 - Phi^p."""
    x = np.linspace(-reach, reach, steps)
    phi = 0.5 * (1.0 + np.array([math.erf(v / math.sqrt(2.0)) for v in x]))
    top = phi**p
    middle = steps // 2  # x = 0 belongs to both halves
    upper = np.trapezoid(1.0 - top[middle:], x[middle:])
    lower = np.trapezoid(top[: middle + 1], x[: middle + 1])
    return float(upper - lower)


def forecasts(spark: SparkSession, units: DataFrame, ps: list[int]) -> DataFrame:
    """Asymptotic and finite-p efficiency forecasts from the spread alone."""
    rows = [(int(p), expected_max_normal(int(p)) if p > 1 else 0.0) for p in ps]
    grid = literal_rows(spark, rows, "p bigint, emax double")
    stats = units.agg(
        F.count(F.lit(1)).alias("n_units"), safe_ratio(F.stddev_pop("n"), F.avg("n")).alias("cv")
    )
    m = F.col("n_units") / F.col("p")
    return grid.crossJoin(stats).select(  # one row of statistics
        "p",
        m.alias("m"),
        "cv",
        forecast_efficiency(F.col("cv"), m, F.col("p")).alias("asymptotic"),
        (1.0 / (1.0 + F.col("cv") / F.sqrt(m) * F.col("emax"))).alias("finite_p"),
    )


def work_profile(work: DataFrame, rhos: list[float]) -> DataFrame:
    """Spread of records, whitelisted records and modelled work, per rho.

    ``work`` is (idx, n, k); h = k / n is the unit's hit rate.
    """
    grid = work.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))
    w = F.col("n") + F.col("rho") * F.col("k")
    h = safe_ratio(F.col("k"), F.col("n"))
    return grid.withColumn("w", w).withColumn("h", h).groupBy("rho").agg(
        safe_ratio(F.stddev_pop("n"), F.avg("n")).alias("cv_records"),
        safe_ratio(F.stddev_pop("k"), F.avg("k")).alias("cv_whitelisted"),
        safe_ratio(F.stddev_pop("w"), F.avg("w")).alias("cv_work"),
        safe_ratio(F.sum("k"), F.sum("n")).alias("hit_rate"),
        F.avg("h").alias("mean_h"),
        F.stddev_pop("h").alias("sd_h"),
        F.corr(F.col("n").cast("double"), F.col("k").cast("double")).alias("corr_n_k"),
        F.corr(F.when(F.col("h").isNotNull(), F.col("n").cast("double")), F.col("h")).alias("corr_n_h"),
    )


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Two independent computations of one quantity: pairs, worst gap, RMS gap."""
    left = a.select(*keys, F.col(value).alias("va"))
    right = b.select(*keys, F.col(value).alias("vb"))
    gap = F.abs(F.col("va") - F.col("vb"))
    return left.join(right, keys, "full").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.max(gap).alias("max_gap"),
        F.sqrt(F.avg(gap * gap)).alias("rms_gap"),
        F.count_if(~F.coalesce(gap <= tolerance, F.lit(False))).alias("n_outside"),
    )


