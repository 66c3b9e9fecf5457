"""Append-only telemetry as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talus.functions.scalars import sanitise_note
from talus.operators.telemetry import row_problems
from talus.sources import schemas


def follow_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Validated runs from every CSV that appears in ``folder``.

    Rows that break a rule keep the list of broken rules instead of stopping
    the stream.
    """
    raw = spark.readStream.schema(schemas.RUNS).option("header", True).csv(folder)
    return raw.withColumn("notes", sanitise_note(F.col("notes"))).withColumn("problems", row_problems())


def append_stream(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid rows to an append-only Parquet table, exactly once."""
    return (
        runs.filter(F.size("problems") == 0)
        .drop("problems")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
