"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.scalars import sanitise_note
from talus.operators.quality import identifier_columns
from talus.operators.records import csr_order

ROWS_PER_FILE = 20_000_000


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, zstd; files are capped so that readers get even splits."""
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Event records in ragged-array order, clustered by unit.

    Unit ranges keep file statistics tight, so reading some units prunes files.
    """
    narrowed = csr_order(records).select(
        "row_index", "dense_id", F.col("t").cast("float").alias("t"), F.col("value").cast("float").alias("value")
    )
    write_table(narrowed, path)


def write_artifact(df: DataFrame, path: str, allow_identifiers: bool = False) -> None:
    """Small published table as one CSV file; refuses direct identifiers."""
    leaking = identifier_columns(df)
    if leaking and not allow_identifiers:
        raise ValueError(f"artifact would publish {leaking}")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append validated telemetry; a bad row fails the write before it commits."""
    from talus.operators.telemetry import row_problems

    checked = runs.withColumn("_p", row_problems())
    message = F.concat(F.lit("invalid run "), F.col("run_id"), F.lit(": "), F.array_join("_p", ", "))
    clean = checked.filter(F.when(F.size("_p") == 0, True).otherwise(F.raise_error(message).cast("boolean")))
    text = [f.name for f in runs.schema.fields if f.dataType.simpleString() == "string"]
    for name in text:
        clean = clean.withColumn(name, sanitise_note(F.col(name)))
    write_table(clean.drop("_p"), path, "append")


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Dense feature matrix, one row per unit."""
    write_table(matrix, path)


def show_table(df: DataFrame, rows: int = 200, width: int = 34) -> None:
    df.show(rows, width)


def latex_rows(df: DataFrame, digits: int = 2) -> DataFrame:
    """One LaTeX table row per input row (small result tables)."""
    cells = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.simpleString() in ("double", "float"):
            c = F.format_string(f"%.{digits}f", c.cast("double"))
        cells.append(F.coalesce(c.cast("string"), F.lit("--")))
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("row"))
