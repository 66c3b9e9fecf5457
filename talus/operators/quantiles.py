"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.session import cut_lineage

def grouped_quantiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], aggregates: list[Column] | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, next to other aggregates.

    ``wanted`` maps result names to (column, quantile); NULLs are ignored, NaN
    is the largest value. One histogram of all columns, (keys, column, value)
    with a count, is range partitioned on all three, which splits even a group
    holding most of the rows, and written once; places and quantiles come from
    it. Spark's ``percentile`` would keep all values of a group in one buffer.
    Only the groups at the edges of a range can go on in the next one, two a
    range at most; theirs alone are the totals that are added up across ranges.
    Without ``aggregates`` the rows are read once: a cell without a value marks
    every group in the histogram, also one that has no values.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    cells = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]
    if not aggregates:
        cells.append(F.struct(F.lit(-1).alias("_c"), F.lit(None).cast("double").alias("_v")))
    present = df.select(*keys, F.explode(F.array(*cells)).alias("_x")).select(*keys, "_x._c", "_x._v").where("_v IS NOT NULL OR _c < 0")
    histogram = present.groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_f"))
    ordered = histogram.repartitionByRange(*[F.col(k) for k in keys], F.col("_c"), F.col("_v"))
    placed = cut_lineage(ordered.withColumn("_part", F.spark_partition_id()))
    group = [*keys, "_c"]
    ends = placed.groupBy("_part").agg(F.min(F.struct(*group)).alias("_a"), F.max(F.struct(*group)).alias("_z"))
    edges = ends.select(F.explode(F.array("_a", "_z")).alias("_e")).select("_e.*").distinct()  # two rows a range
    totals = join_null_safe(placed, F.broadcast(edges), group, "left_semi").groupBy(*group, "_part").agg(F.sum("_f").alias("_t"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *group, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"), F.sum("_t").over(whole).alias("_all")
    )
    own_part = Window.partitionBy(*group, "_part")
    inside = own_part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_hi", F.sum("_f").over(inside)).withColumn(
        "_own", F.sum("_f").over(own_part.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    ranked = (
        join_null_safe(local, F.broadcast(bases), [*group, "_part"])
        .withColumn("_hi", F.coalesce("_base", F.lit(0)) + F.col("_hi"))
        .withColumn("_n", F.coalesce("_all", "_own"))
        .withColumn("_lo", F.col("_hi") - F.col("_f"))
    )
    picks = []
    for i, (column, q) in enumerate(wanted.values()):
        own = F.col("_c") == columns.index(column)
        at = F.lit(q) * (F.col("_n") - 1)
        for side, pos in (("a", F.floor(at)), ("b", F.ceil(at))):
            hit = own & (F.col("_lo") <= pos) & (pos < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(F.when(own, at - F.floor(at))).alias(f"_w{i}"))
    found = ranked.groupBy(*keys).agg(*picks)
    results = [_between(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_w{i}")).alias(name) for i, name in enumerate(wanted)]
    if not aggregates:
        return found.select(*keys, *results)
    return join_null_safe(df.groupBy(*keys).agg(*aggregates), found.select(*keys, *results), keys)


def _between(a: Column, b: Column, weight: Column) -> Column:
    """Linear interpolation that leaves equal ends, infinite ones too, as they are."""
    return F.when(a == b, a).otherwise(a * (1 - weight) + b * weight)


def medians(df: DataFrame, keys: list[str], columns: dict[str, str], aggregates: list[Column] | None = None) -> DataFrame:
    """Medians of several columns per group; ``columns`` maps result -> source."""
    return grouped_quantiles(df, keys, {name: (c, 0.5) for name, c in columns.items()}, aggregates)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` that treats NULL keys as equal."""
    if not keys:
        return left.crossJoin(right)  # both sides hold a single row
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    if how == "left_semi":
        return left.join(other, cond, how)
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])
