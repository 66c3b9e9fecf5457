"""Readers for tables and telemetry."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.sources import schemas

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv_table(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """CSV with header; quoted fields may hold commas, line breaks, doubled quotes.

    A gzip file is one split whatever its size, so its rows are spread over the
    cluster right after decoding; give ``partitions`` for large files.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )
    return df.repartition(partitions) if partitions else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_clinical(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All converted clinical tables of a folder of Parquet datasets."""
    return {name: read_table(spark, f"{folder}/{name}.parquet") for name in schemas.CLINICAL}


def footer_count(spark: SparkSession, path: str) -> int:
    """Row count; no column is read, only row-group metadata."""
    return spark.read.parquet(path).count()


def read_lookup(spark: SparkSession, path: str, n_ids: int) -> DataFrame:
    """Kernel lookup CSV completed to one row per dense id.

    Ids the file does not mention are dropped ids (slot -1, open bounds);
    columns after the sixth are ignored.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("dense_id"))
    cells = F.split("value", ",")
    types = T.StructType.fromDDL(schemas.LOOKUP)
    rows = lines.select(*[cells.getItem(i).cast(f.dataType).alias(f.name) for i, f in enumerate(types.fields)])
    ids = spark.range(n_ids).select(F.col("id").cast("int").alias("dense_id"))
    return ids.join(rows, "dense_id", "left").na.fill(schemas.LOOKUP_DEFAULTS)


def lookup_gaps(spark: SparkSession, path: str, n_ids: int) -> DataFrame:
    """Dense ids without a row in the lookup file."""
    present = spark.read.text(path).select(F.split("value", ",").getItem(0).try_cast("int").alias("dense_id"))
    ids = spark.range(n_ids).select(F.col("id").cast("int").alias("dense_id"))
    return ids.join(present, "dense_id", "left_anti")


def _headers(spark: SparkSession, paths: list[str], names: set[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header, the first line that isn't blank of each file; raises where it names no declared column."""
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), place.alias("place")).where("trim(value) <> ''")
    found: dict[tuple[str, ...], list[str]] = {}
    for row in lines.groupBy("path").agg(F.min_by("value", "place").alias("line")).orderBy("path").collect():  # one row per file
        cells = next(csv.reader([row["line"].removeprefix("\ufeff")]))
        header = tuple(c.strip() or f"_c{i}" for i, c in enumerate(cells))
        if not names & set(header):
            raise ValueError(f"{row['path']}: no usable header, its first line names no declared column")
        if len({c.lower() for c in header}) < len(header):
            raise ValueError(f"{row['path']}: repeated columns in the header")
        found.setdefault(header, []).append(row["path"])
    return found


def read_telemetry(spark: SparkSession, paths: list[str], required: str | None = None) -> DataFrame:
    """Union of telemetry CSVs whose columns differ, with the file name.

    Files with equal headers are read together, with their own columns (as
    text) cast to the declared type where there is one. Files without
    ``required``, and empty files, are skipped; any other file whose header
    names no declared column raises.
    """
    known = {f.name: f.dataType for text in (schemas.RUNS, schemas.THREADS) for f in T.StructType.fromDDL(text).fields}
    frames = []
    for header, files in _headers(spark, paths, set(known)).items():
        if required and required not in header:
            continue
        as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(as_text).option("header", True).csv(files)
        typed = [F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in header]
        frames.append(raw.select(*typed, F.col("_metadata.file_name").alias("__file")))
    if not frames:
        raise ValueError(f"no usable telemetry file among {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def schema_drift(spark: SparkSession, path: str, declared: str = schemas.RUNS) -> list[str]:
    """Differences between a file's header and the declared columns, in order."""
    header = spark.read.option("header", True).csv(path).columns
    wanted = T.StructType.fromDDL(declared).fieldNames()
    found = [f"missing {c}" for c in wanted if c not in header] + [f"unexpected {c}" for c in header if c not in wanted]
    if not found and header != wanted:
        found.append("column order differs")
    return found


def load_runs(spark: SparkSession, path: str, drop_warmup: bool = True) -> DataFrame:
    """Runs with the exact declared header; invalid rows raise when read."""
    from talus.operators.telemetry import row_problems

    drift = schema_drift(spark, path)
    if drift:
        raise ValueError(f"{path}: {', '.join(drift)}")
    df = spark.read.schema(schemas.RUNS).option("header", True).option("enforceSchema", False).csv(path)
    checked = df.withColumn("_p", row_problems())
    message = F.concat(F.lit("invalid run "), F.col("run_id"), F.lit(": "), F.array_join("_p", ", "))
    valid = checked.filter(F.when(F.size("_p") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_p")
    return valid.filter("warmup = 0") if drop_warmup else valid


# Record kinds of the mixed probe file and their field counts.
PROBE_KINDS = {
    "RUN": ("tag string, node string, threads int, bind string, policy string, rep int, path string, "
            "bytes double, secs double, gb_s double, checksum string, ghz double", 13),
    "THR": ("tag string, rep int, tid int, cpu int, node string, bytes double, secs double, gb_s double, "
            "local double, remote double", 11),
    "NUMA": ("tag string, path string, node int, pages bigint, bytes double, total bigint, share double", 8),
}


def read_probe(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Split a text file of RUN, THR and NUMA records; other lines are ignored."""
    cells = spark.read.text(path).select(F.split("value", ",").alias("a"))
    out = {}
    for kind, (schema, arity) in PROBE_KINDS.items():
        fields = T.StructType.fromDDL(schema).fields
        rows = cells.filter((F.col("a").getItem(0) == kind) & (F.size("a") == arity))
        out[kind] = rows.select(
            *[F.trim(F.col("a").getItem(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
        )
    return out


SWEEP = (
    "n_units bigint, n_records bigint, max_unit bigint, mean_unit double, median_unit double, p99_unit double, "
    "p99_over_median double, cv double, gini double, max_over_mean double, p_atom double, p_star bigint, "
    "source string, pstar_computed boolean, sweep array<struct<p: bigint, regime: string, regime_name: string, "
    "headline: string, actions: array<string>, ceiling: double, ceiling_vs_rung: double, resolvable: boolean, "
    "p_over_p_atom: double>>"
)


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Advisor results (one JSON document per file) with the variant's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"sweep_(.*)\.json$", 1)
    return spark.read.schema(SWEEP).option("multiLine", True).json(path).withColumn("variant", name)


def variant_table(sweeps: DataFrame, ps: tuple[int, ...] = (16, 32, 64, 80)) -> DataFrame:
    """p*, p_atom and the ceilings (in %) at the reported partition counts."""
    long = sweeps.select("variant", "n_units", "n_records", "p_star", "p_atom", F.inline("sweep"))
    cells: list[Column] = [F.max(F.when(F.col("p") == p, 100.0 * F.col("ceiling"))).alias(f"C{p}") for p in ps]
    return long.groupBy("variant", "n_units", "n_records", "p_star", "p_atom").agg(*cells)


def unique_variants(sweeps: DataFrame) -> DataFrame:
    """First variant by name of every (units, records, p*, p_atom) signature."""
    from pyspark.sql import Window

    same = Window.partitionBy("n_units", "n_records", "p_star", "p_atom").orderBy("variant")
    return sweeps.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1").drop("_rn")
