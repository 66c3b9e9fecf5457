"""Named queries and the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def normalise(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Widen numbers and round doubles so that two engines can be compared.

    NaN becomes NULL and -0.0 becomes 0.0.
    """
    columns = []
    for field in df.schema.fields:
        c = f"`{field.name}`"
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"CAST({c} AS BIGINT)"
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = f"CAST({c} AS DOUBLE)"
            c = f"CASE WHEN NOT isnan({d}) THEN round({d}, {digits}) + 0D END"
        columns.append(f"{c} AS `{field.name}`")
    return df.selectExpr(*columns)


def normalise_sql(sql: str, doubles: str, ints: str, digits: int = DIGITS) -> str:
    """The same for the oracle text; the columns are listed by name."""
    parts = [
        f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE END AS {c}"
        for c in doubles.split()
    ]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"SELECT *{replace} FROM ({sql}) AS result"


def query(
    name: str, oracle: str | None = None, doubles: str = "", ints: str = "", digits: int = DIGITS
) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``doubles`` and ``ints`` name the oracle's columns to normalise."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: normalise(fn(spark, sf_dir), digits)
        if oracle is not None:
            ORACLES[name] = normalise_sql(oracle, doubles, ints, digits)
        return fn

    return register
