"""Session construction and lineage cutting."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BROADCAST_BYTES = 64 << 20


def build_session(app: str = "talus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    ANSI mode stays on (Spark's default); timestamps are compared as UTC wall
    clock; AQE coalesces partitions, turns small joins into broadcast joins
    from measured sizes and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It comes from ``spark.checkpoint.dir``. Where that is unset, the tables go
    into a folder of this application under the warehouse, which the session
    names and all executors share too; never into a machine's temporary folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/talus-{sc.applicationId}"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it when no result is read any more."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the table.

    Used where several later steps read the same rows, or must see exactly the
    same rows in the same partitions (range partitioning picks its bounds by
    sampling) even after executors were lost. A Parquet table keeps column
    pruning, filter pushdown and size statistics, which checkpoint files lose.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation of values known on the driver, of any number of rows.

    It travels as one Arrow table, which gives the optimizer its exact size.
    """
    columns = T.StructType.fromDDL(schema)
    arrays = [pa.array([row[i] for row in rows], to_arrow_type(f.dataType)) for i, f in enumerate(columns.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=columns.names), columns)


def row_bytes(schema: T.StructType) -> int:
    """A generous width of a row: 8 bytes a number, 64 a text, 256 anything nested."""
    flat = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return sum(8 if isinstance(f.dataType, flat) else 64 if isinstance(f.dataType, T.StringType) else 256 for f in schema.fields)


def broadcast_if_bounded(df: DataFrame, row_bound: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the caller can prove a row bound.

    The bound counts in bytes, rows times their width. Beyond ``limit`` the
    join is left to AQE, which measures the side at run time.
    """
    return F.broadcast(df) if row_bound * row_bytes(df.schema) <= limit else df


def broadcast_counted(df: DataFrame) -> DataFrame:
    """Count a lookup side, then hint a broadcast if it is small enough."""
    return broadcast_if_bounded(df, df.count())
