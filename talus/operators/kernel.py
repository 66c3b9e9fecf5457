"""Feature kernel: eight aggregates per (unit, variable slot)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.scalars import clip, order_bits
from talus.session import broadcast_counted

# Aggregate order of the feature matrix and the cost model.
AGGREGATES = ("count", "mean", "min", "max", "std", "first", "last", "slope")
RECORD_COST = 5.31
ID_LIMIT = 1 << 26


def _as_stored(name: str) -> Column:
    """Single-precision value widened back to double."""
    return F.col(name).cast("float").cast("double")


def slotted(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Records of kept variables with harmonised, clipped values.

    Only lookup rows with a slot take part; they are counted before a broadcast.
    """
    kept = lookup.filter("slot >= 0").select("dense_id", "slot", "vscale", "voffset", "lo", "hi")
    value = _as_stored("value") * _as_stored("vscale") + _as_stored("voffset")
    return records.join(broadcast_counted(kept), "dense_id").select(
        "row_index",
        "slot",
        F.col("t").alias("t_exact"),
        "dense_id",
        F.col("value").alias("value_exact"),
        _as_stored("t").alias("t"),
        clip(value, _as_stored("lo"), _as_stored("hi")).alias("v"),
    )


def record_order() -> Column:
    """The order (t, id, stored value) of a record as one number of 38 digits.

    64 bits of time, 26 of the dictionary id, 35 of the single-precision value:
    records that agree in all three give equal features. An id beyond 26 bits
    raises an error.
    """
    value = F.shiftright(order_bits(_as_stored("value_exact")), 29) + F.lit(1 << 34)
    fits = (F.col("dense_id") >= 0) & (F.col("dense_id") < ID_LIMIT)
    known = F.when(fits, F.col("dense_id").cast("long")).otherwise(F.raise_error(F.lit("dictionary id beyond 26 bits")).cast("long"))
    low = known * F.lit(1 << 35) + value
    wide = order_bits(F.col("t_exact").cast("double")).cast("decimal(20,0)") * F.lit(1 << 61).cast("decimal(19,0)")
    return (wide + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def kernel(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Long feature table, one row per non-empty (row_index, slot).

    A single grouped hash aggregation: every aggregate merges in a buffer of
    fixed width, so a unit holding a large share of the records is reduced
    map-side before the shuffle, and nothing is sorted. First and last follow
    the stored record order (t, id, value).
    """
    keyed = slotted(records, lookup).withColumn("order", record_order())
    order = F.col("order")
    return (
        keyed.groupBy("row_index", "slot")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("v").alias("mean"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.stddev_pop("v").alias("std"),
            F.min_by("v", order).alias("first"),
            F.max_by("v", order).alias("last"),
            F.regr_slope("v", "t").alias("slope"),
        )
    )


def feature_matrix(features: DataFrame, units: DataFrame, n_slots: int) -> DataFrame:
    """Wide form: one row per unit, slot-major columns s<slot>_<aggregate>.

    Counts of empty cells are 0 and their other aggregates NaN, as consumers
    of the dense matrix expect.
    """
    nan = F.lit(float("nan"))
    cells = []
    for slot in range(n_slots):
        for agg in AGGREGATES:
            cell = F.max(F.when(F.col("slot") == slot, F.col(agg).cast("double")))
            cells.append(cell.alias(f"s{slot}_{agg}"))
    wide = features.groupBy("row_index").agg(*cells)
    joined = units.select("row_index").join(wide, "row_index", "left")
    return joined.select(
        "row_index",
        *[
            F.coalesce(F.col(f"s{s}_{a}"), F.lit(0.0) if a == "count" else nan).alias(f"s{s}_{a}")
            for s in range(n_slots)
            for a in AGGREGATES
        ],
    )


def unit_work(units: DataFrame, records: DataFrame, lookup: DataFrame, rho: float = RECORD_COST) -> DataFrame:
    """(idx, n, k, work): records, whitelisted records, n + rho * k."""
    kept = lookup.filter("slot >= 0").select("dense_id", F.lit(1).alias("hit"))
    counts = (
        records.join(broadcast_counted(kept), "dense_id", "left")
        .groupBy(F.col("row_index").alias("idx"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))
    )
    return (
        units.select("idx").join(counts, "idx", "left").na.fill(0, ["n", "k"])
        .withColumn("work", F.col("n") + F.lit(rho) * F.col("k"))
    )


def whitelist_all(lookup: DataFrame, n_slots: int) -> DataFrame:
    """Stress variant that keeps every id, spread over the slots."""
    return lookup.withColumn("slot", F.pmod(F.col("dense_id"), F.lit(n_slots)))


def whitelist_none(lookup: DataFrame) -> DataFrame:
    """Stress variant that drops every id."""
    return lookup.withColumn("slot", F.lit(-1))


def feature_differences(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cells of two long feature tables that differ (NULL/NaN safe).

    Sums of doubles depend on the order partial results meet, so runs with
    other partitionings agree up to a relative ``tolerance`` only.
    """
    a, b = left.alias("a"), right.alias("b")
    cond = F.expr("a.row_index = b.row_index AND a.slot = b.slot")
    same = F.expr(
        " AND ".join(
            f"(a.{n} <=> b.{n} OR coalesce(abs(a.{n} - b.{n}) <= {tolerance}D * greatest(1D, abs(a.{n})), false))"
            for n in AGGREGATES
        )
    )
    return a.join(b, cond, "full").filter(~same).select(
        F.coalesce("a.row_index", "b.row_index").alias("row_index"),
        F.coalesce("a.slot", "b.slot").alias("slot"),
    )


def checksum(features: DataFrame) -> DataFrame:
    """Sum of all finite cells, for quick comparison of runs."""
    total = F.lit(0.0)
    for name in AGGREGATES:
        total = total + F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return features.agg(F.count(F.lit(1)).alias("n_cells"), F.sum(total).alias("checksum"))


def sentinel_violations(features: DataFrame) -> DataFrame:
    """Cells with one record must have zero spread and no slope."""
    single = F.col("count") == 1
    return features.agg(
        F.count_if(single).alias("n_single"),
        F.count_if(single & (F.col("std") != 0)).alias("n_single_with_spread"),
        F.count_if(single & F.col("slope").isNotNull()).alias("n_single_with_slope"),
        F.count_if((F.col("count") < 1) | F.col("mean").isNull()).alias("n_empty_cells"),
    )
