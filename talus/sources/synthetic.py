"""Generated workloads for trials without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lognormal_units(spark: SparkSession, n: int, records: int, largest: int, seed: int = 0) -> DataFrame:
    """(idx, n) log-normal sizes scaled to ``records``; the top one is ``largest``.

    Replacing the largest size changes the record total; use the given totals,
    not the generated ones, where N / max must be exact.
    """
    raw = spark.range(n).select(F.col("id").alias("idx"), F.exp(F.randn(seed)).alias("x"))
    total = raw.agg(F.sum("x").alias("s"), F.max(F.struct("x", "idx")).alias("top"))
    scaled = F.greatest(F.lit(1), F.round(F.col("x") / F.col("s") * records)).cast("long")
    return raw.crossJoin(F.broadcast(total)).select(  # one row
        "idx", F.when(F.col("idx") == F.col("top.idx"), F.lit(largest)).otherwise(scaled).alias("n")
    )


def pareto_units(spark: SparkSession, n: int, seed: int = 0, shape: float = 1.1) -> DataFrame:
    """(idx, n) with sizes floor(pareto(shape) * 20 + 1)."""
    draw = F.pow(1.0 - F.rand(seed), F.lit(-1.0 / shape)) - 1.0
    return spark.range(n).select(F.col("id").alias("idx"), F.floor(draw * 20 + 1).alias("n"))


