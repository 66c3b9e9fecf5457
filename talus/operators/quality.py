"""Integrity checks over source tables and derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import safe_ratio
from talus.operators.records import BYTES_PER_RECORD

# Acceptance threshold of the coverage checks and list length.
COVERAGE_THRESHOLD_PCT = 99.0
TOP_ITEMS = 15
IDENTIFIERS = ("subject_id", "hadm_id", "stay_id")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, pct_null) for every column in one pass."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("n_rows"),
            F.col(f"null_{c}").alias("n_null"),
            (100.0 * safe_ratio(F.col(f"null_{c}"), F.col("n_rows"))).alias("pct_null"),
        )
        for c in df.columns
    ]
    return sums.select(F.inline(F.array(*rows)))


def row_count_check(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Actual against expected row counts; ``expected`` is (name, n_expected)."""
    actual = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        actual = one if actual is None else actual.unionByName(one)
    return actual.join(expected, "name", "full").withColumn(
        "ok", F.col("n_rows").eqNullSafe(F.col("n_expected"))
    )


def covered_keys(keys: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """How many distinct keys have at least one row of evidence."""
    wanted = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    seen = evidence.select(key).distinct().withColumn("seen", F.lit(1))
    return (
        wanted.join(seen, key, "left")
        .agg(F.count(F.lit(1)).alias("n_keys"), F.count("seen").alias("n_with"))
        .withColumn("pct", 100.0 * safe_ratio(F.col("n_with"), F.col("n_keys")))
        .withColumn("ok", F.coalesce(F.col("pct") >= COVERAGE_THRESHOLD_PCT, F.lit(False)))
    )


def item_coverage(stays: DataFrame, chartevents: DataFrame, d_items: DataFrame, label: str) -> DataFrame:
    """Share of stays with at least one record of the items labelled ``label``."""
    wanted = d_items.filter(F.lower("label") == label.lower()).select("itemid")
    evidence = chartevents.join(wanted, "itemid", "left_semi")
    return covered_keys(stays, evidence, "stay_id")


def _item_nulls(chartevents: DataFrame) -> DataFrame:
    """Records and NULL values per item, before any label is attached."""
    return chartevents.groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("valuenum").isNull()).alias("n_null")
    )


def null_share_by_type(chartevents: DataFrame, d_items: DataFrame) -> DataFrame:
    """NULL values per parameter type and their share of all NULL values.

    Records are counted per item first, so the join sees items, not records.
    """
    typed = _item_nulls(chartevents).join(d_items.select("itemid", "param_type"), "itemid", "left")
    everywhere = Window.partitionBy()  # a handful of parameter types
    return (
        typed.groupBy(F.coalesce("param_type", F.lit("(not in d_items)")).alias("param_type"))
        .agg(F.sum("n_records").alias("n_records"), F.sum("n_null").alias("n_null"))
        .withColumn("pct_null_within", F.round(100.0 * safe_ratio(F.col("n_null"), F.col("n_records")), 2))
        .withColumn("pct_of_all_nulls", F.round(100.0 * safe_ratio(F.col("n_null"), F.sum("n_null").over(everywhere)), 2))
    )


def top_null_items(chartevents: DataFrame, d_items: DataFrame, k: int = TOP_ITEMS) -> DataFrame:
    """The k items with most NULL values (top-k report)."""
    labels = d_items.select("itemid", "label", "param_type")
    return (
        _item_nulls(chartevents)
        .filter("n_null > 0")
        .join(labels, "itemid", "left")
        .select(
            "itemid",
            F.coalesce("label", F.lit("?")).alias("label"),
            F.coalesce("param_type", F.lit("?")).alias("param_type"),
            "n_null",
        )
        .orderBy(F.desc("n_null"), F.asc("itemid"))
        .limit(k)
    )


def usable_records(chartevents: DataFrame, labevents: DataFrame) -> DataFrame:
    """Usable records per source and the size they would take."""
    chart = chartevents.agg(F.count(F.lit(1)).alias("total"), F.count("valuenum").alias("usable"))
    lab = labevents.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("valuenum").isNotNull() & F.col("hadm_id").isNotNull()).alias("usable"),
    )
    each = chart.withColumn("source", F.lit("chartevents")).unionByName(lab.withColumn("source", F.lit("labevents")))
    both = each.agg(F.sum("total").alias("total"), F.sum("usable").alias("usable")).withColumn("source", F.lit("combined"))
    return each.unionByName(both).select(
        "source",
        "total",
        "usable",
        (100.0 * safe_ratio(F.col("usable"), F.col("total"))).alias("pct_usable"),
        (F.col("usable") * BYTES_PER_RECORD).alias("bytes"),
    )


def dense_permutation(df: DataFrame, column: str = "row_index") -> DataFrame:
    """Is the column a permutation of 0..n-1?"""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.count_distinct(column).alias("n_distinct"),
    )
    return stats.withColumn(
        "ok", (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n"))
    )


def reproduction(measured: DataFrame, expected: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Measured against registered values with a relative tolerance per column."""
    wanted = expected.select(key, *[F.col(c).alias(f"want_{c}") for c in tolerances])
    joined = measured.join(wanted, key, "full")
    ok = F.lit(True)
    for column, tolerance in tolerances.items():
        ok = ok & F.coalesce(F.expr(f"abs({column} - want_{column}) <= {tolerance}D * abs(want_{column})"), F.lit(False))
    return joined.withColumn("ok", ok)


def identifier_columns(df: DataFrame) -> list[str]:
    """Direct identifiers that must not leave in a published artifact."""
    return [c for c in df.columns if c.lower() in IDENTIFIERS]
