"""How unevenly records are spread over units.

Every statistic is computed from the histogram of unit sizes, one row per
distinct size. Distinct non-negative integers that add up to N number at most
sqrt(2N) + 1, so the histogram of 10^13 records has under five million rows,
however many units there are and however often one size repeats.

Functions take a unit table with a size column ``n`` and optional ``by``
columns, so that many workloads are analysed in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.prefix import block_scan

# Reporting quantiles, tail fractions and the heavy-tail gate.
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
HILL_FRACTIONS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10)
GATE_GINI = 0.40
GATE_P99_OVER_MEDIAN = 10.0

_VALUE_BLOCK = 4096


def _sizes(units: DataFrame, by: list[str]) -> DataFrame:
    return units.groupBy(*by, "n").agg(F.expr("count(1) AS f"))


def size_histogram(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, f, cf, cw): size, units of that size, running units and records."""
    return block_scan(
        _sizes(units, by or []),
        F.expr(f"floor(n / {_VALUE_BLOCK})"),
        [F.col("n")],
        {"cf": F.col("f"), "cw": F.expr("n * f")},
        by=by,
    )


def totals(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group: unit count, record count, extremes and empties."""
    return _sizes(units, by or []).groupBy(*(by or [])).agg(
        F.expr("coalesce(sum(f), 0) AS n_units"),
        F.expr("coalesce(sum(n * f), 0) AS n_records"),
        F.expr("coalesce(sum(f) FILTER (WHERE n = 0), 0) AS n_empty"),
        F.expr("coalesce(sum(f) FILTER (WHERE n > 0), 0) AS n_pos"),
        F.expr("min(n) AS min_unit"),
        F.expr("max(n) AS max_unit"),
        F.expr("sum(n * f) / sum(f) AS mean_unit"),
    )


def with_totals(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    sums = totals(units, by)
    histogram = size_histogram(units, by)
    # without groups the right side is a single row
    return histogram.join(sums, by) if by else histogram.crossJoin(F.broadcast(sums))


# Columns of a histogram row: cf - f units are smaller, n_units - cf are larger.
def _value_at(position: str) -> str:
    return f"max(n) FILTER (WHERE cf - f <= {position} AND {position} < cf)"


def _quantile(q: float) -> str:
    at = f"{q}D * (n_units - 1)"
    low, high = _value_at(f"floor({at})"), _value_at(f"ceil({at})")
    return f"{low} + ({high} - {low}) * max({at} - floor({at}))"


def _taken_from_top(k: str) -> str:
    """How many units of this size are among the k largest."""
    return f"greatest(0, least(f, {k} - (n_units - cf)))"


_GINI = (
    "coalesce(2D * sum(CAST(n AS DOUBLE) * (f * (cf - f) + f * (f + 1) / 2D)) "
    "/ (max(n_units) * nullif(CAST(max(n_records) AS DOUBLE), 0D)) "
    "- (max(n_units) + 1) / CAST(max(n_units) AS DOUBLE), 0D)"
)
_TOP_SHARE = (
    f"sum({_taken_from_top('greatest(1, floor(n_units / 100))')} * n) / nullif(CAST(max(n_records) AS DOUBLE), 0D)"
)


def _hill_k(fraction: float) -> str:
    return f"greatest(2, floor({fraction}D * n_pos))"


def _hill(fraction: float) -> str:
    """1 / mean log excess of the k largest over the next one below."""
    k = _hill_k(fraction)
    threshold = f"max(ln(n)) FILTER (WHERE n > 0 AND n_units - cf <= {k} AND {k} < n_units - cf + f)"
    logs = f"sum({_taken_from_top(k)} * ln(n)) FILTER (WHERE n > 0)"
    excess = f"({logs} / max({k}) - {threshold})"
    return f"CASE WHEN max({k}) < max(n_pos) AND {excess} > 1e-15 THEN 1D / {excess} END"


def hill_name(fraction: float) -> str:
    return f"hill_{fraction:g}".replace(".", "_")


def describe(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summary of a unit table, one row per group."""
    scalars = ["n_units", "n_records", "n_empty", "min_unit", "max_unit", "mean_unit"]
    aggregates = [f"max({c}) AS {c}" for c in scalars]
    aggregates += [f"{_GINI} AS gini", f"{_TOP_SHARE} AS top1pct_share"]
    aggregates += [f"{_quantile(q)} AS {name}" for name, q in QUANTILES.items()]
    aggregates += [f"{_hill(f)} AS {hill_name(f)}" for f in HILL_FRACTIONS]
    aggregates.append("sum(f * power(n - mean_unit, 2)) AS squares")
    rows = with_totals(units, by).groupBy(*(by or [])).agg(*[F.expr(a) for a in aggregates])
    spread = rows.selectExpr(
        "*", "sqrt(squares / nullif(n_units - 1, 0)) AS std_samp", "sqrt(squares / nullif(n_units, 0)) AS std_pop"
    ).drop("squares")
    return spread.selectExpr(
        "*",
        "std_samp / nullif(mean_unit, 0) AS cv_samp",
        "std_pop / nullif(mean_unit, 0) AS cv_pop",
        "p99 / nullif(p50, 0) AS p99_over_median",
        "max_unit / nullif(p50, 0) AS max_over_median",
        "max_unit / nullif(mean_unit, 0) AS max_over_mean",
        "n_records / nullif(CAST(max_unit AS DOUBLE), 0) AS p_atom",
    )


def heavy_tail_gate(summary: DataFrame) -> DataFrame:
    """Adds the verdict of the pre-registered heavy-tail gate (strict bounds)."""
    return summary.withColumn(
        "heavy_tailed", F.expr(f"gini > {GATE_GINI} AND p99_over_median > {GATE_P99_OVER_MEDIAN}")
    )


def ccdf(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """P(size >= x) over the positive units, one row per distinct size."""
    return with_totals(units, by).filter("n > 0").selectExpr(
        *(by or []), "n AS x", "f AS n_units_at", "1D - (cf - f - n_empty) / n_pos AS ccdf"
    )


def lorenz(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cumulative share of units against cumulative share of records."""
    return with_totals(units, by).selectExpr(
        *(by or []), "n AS x", "cf / n_units AS unit_share", "cw / nullif(CAST(n_records AS DOUBLE), 0) AS record_share"
    )


def hill_series(units: DataFrame, fractions: tuple[float, ...] = HILL_FRACTIONS) -> DataFrame:
    """Long form of the tail index: one row per tail fraction."""
    cells = [F.expr(f"struct({f}D AS fraction, max({_hill_k(f)}) AS k, {_hill(f)} AS hill)") for f in fractions]
    return with_totals(units).groupBy().agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
