"""Ragged arrays stored as raw little-endian files: records, units, manifests, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.records import csr_order
from talus.session import literal_rows
from talus.sources import ragged

READ_BYTES = 1 << 23


def read_offsets(spark: SparkSession, path: str, kind: str = "i64") -> DataFrame:
    """(idx, n, start, stop) per unit; rejects short, falling and empty offsets."""
    if kind not in ragged.KINDS:
        raise ValueError(f"dtype {kind} not in {sorted(ragged.KINDS)}")
    spark.dataSource.register(ragged.RaggedSource)
    units = spark.read.format("ragged").option("content", "units").option("kind", kind).load(path)
    row = units.agg(F.count(F.lit(1)).alias("n_units"), F.min("n").alias("low"), F.sum("n").alias("total")).first()
    if row["n_units"] < 1:
        raise ValueError(f"{path}: offsets need at least two entries")
    if row["low"] < 0:
        raise ValueError(f"{path}: offsets decrease")
    if row["total"] == 0:
        raise ValueError(f"{path}: empty workload")
    return units


def read_ragged(spark: SparkSession, folder: str) -> DataFrame:
    """(row_index, dense_id, t, value) of a ragged-array folder, whole or in parts.

    Lengths are checked at once, from file sizes and the last offsets; falling
    offsets are refused by the task that reads them.
    """
    ragged.parts_of(folder)
    spark.dataSource.register(ragged.RaggedSource)
    return spark.read.format("ragged").load(folder)


def write_ragged(records: DataFrame, folder: str, n_units: int | None = None) -> None:
    """Records in the canonical order as parts of a new ragged-array folder.

    One range sort by the whole key: a large unit spans several parts. A part is
    written by one task and counts once the manifest names it, so a task that is
    run again leaves nothing behind that is read. ``n_units`` counts units with
    higher numbers than the last record's, which have none.
    """
    spark = records.sparkSession
    spark.dataSource.register(ragged.RaggedSource)
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ragged.RECORDS.split(", ")]
    writer = csr_order(records).select(*columns).write.format("ragged").mode("append")
    (writer if n_units is None else writer.option("n_units", n_units)).save(folder)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of files of any size, each read in blocks by one task.

    A digest of a whole file is sequential by definition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = ragged.located(path)
                known, length = hashlib.sha256(), 0
                with fs.open_input_stream(place) as source:
                    while block := source.read(READ_BYTES):
                        known.update(block)
                        length += len(block)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "sha256": [known.hexdigest()]})

    files = literal_rows(spark, [(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(run, "path string, length bigint, sha256 string")


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, stated, found, ok): what a folder's manifest states against what the arrays hold.

    Of meta.json or parts.json the counts of units and records and the digests
    of the files are checked, as far as they are stated.
    """
    parts = ragged.parts_of(folder)
    manifest = ragged.read_json(f"{folder}/{ragged.MANIFEST}")
    whole = manifest is None
    stated = (ragged.read_json(f"{folder}/meta.json") or {}) if whole else manifest
    units = parts[0].n_units if whole else max((p.first_unit + p.n_units for p in parts), default=0)
    counts = {"n_stays": max(units, 0 if whole else stated["n_stays"]), "n_records": sum(p.stop for p in parts)}
    rows = [(name, str(stated[name]), str(found)) for name, found in counts.items() if name in stated]
    tables = [("", stated.get("sha256", {}))] if whole else [(f"{p['folder']}/", p["sha256"]) for p in stated["parts"]]
    named = {f"{folder}/{at}{file}": (f"{at}{file}", digest) for at, known in tables for file, digest in known.items()}
    result = literal_rows(spark, rows, "entry string, stated string, found string")
    if named:
        asked = literal_rows(spark, [(path, *x) for path, x in named.items()], "path string, entry string, stated string")
        found = digests(spark, list(named)).select("path", F.col("sha256").alias("found"))
        result = result.unionByName(asked.join(found, "path").select("entry", "stated", "found"))
    return result.withColumn("ok", F.col("stated") == F.col("found"))


def write_manifest(path: str, entries: dict) -> None:
    """A JSON file on any file system that the path names."""
    fs, place = ragged.located(path)
    with fs.open_output_stream(place) as out:
        out.write((json.dumps(entries, indent=2, default=str) + "\n").encode())
