"""Sources and sinks: given tables written to the shared folder, read back, compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talus.operators import telemetry as te
from talus.plans.adapters import oracle_prefix, relation, table
from talus.plans.feature_queries import EVENT_TYPES, SPEC_SQL, event_records, specification
from talus.plans.registry import query
from talus.plans.telemetry_queries import PROBLEMS_SQL
from talus.session import ensure_checkpoint_dir
from talus.sinks import files as sink
from talus.sources import arrays, files


def folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("csv_round_trip", oracle="SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def csv_round_trip(spark, d):
    """Texts with commas, quotes and line breaks through gzip CSV."""
    path, schema = folder(spark), "doc_id bigint, text string, lang string, n_chars bigint"
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    options = {"header": True, "quoteAll": True, "escape": '"', "compression": "gzip", "ignoreLeadingWhiteSpace": False}
    docs.write.options(**options, ignoreTrailingWhiteSpace=False).csv(path)
    return files.read_csv_table(spark, path, schema).select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query(
    "telemetry_round_trip",
    oracle=oracle_prefix("runs") + """ SELECT run_id, schedule, n_threads, n_records,
        CASE WHEN n_threads % 2 = 0 THEN l3_tcm END AS l3_tcm FROM runs""",
    ints="n_threads n_records l3_tcm",
)
def telemetry_round_trip(spark, d):
    """Runs in files of two headers: those of odd thread counts lack a counter."""
    runs, paths = relation(spark, d, "runs"), [folder(spark), folder(spark)]
    runs.where("n_threads % 2 = 0").write.option("header", True).csv(paths[0])
    runs.where("n_threads % 2 <> 0").drop("l3_tcm").write.option("header", True).csv(paths[1])
    return files.read_telemetry(spark, paths).select("run_id", "schedule", "n_threads", "n_records", "l3_tcm")


@query("append_round_trip", oracle=PROBLEMS_SQL + " SELECT run_id, 2::BIGINT AS copies FROM flags WHERE len(problems) = 0")
def append_round_trip(spark, d):
    """Valid runs appended twice; the sink refuses others."""
    path, runs = folder(spark), relation(spark, d, "runs")
    valid = runs.where(F.size(te.row_problems()) == 0)
    for _ in range(2):
        sink.append_runs(valid, path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "lookup_round_trip",
    oracle=SPEC_SQL + " SELECT dense_id, slot, vscale, voffset, lo, hi FROM lookup",
    doubles="vscale voffset lo hi",
    ints="dense_id slot",
    digits=3,
)
def lookup_round_trip(spark, d):
    """The kernel's lookup through its CSV form; bounds are single precision, so three digits are compared."""
    path, lookup = folder(spark), specification(spark, d).lookup()
    names = ["dense_id", "slot", "vscale", "voffset", "lo", "hi", "bounds_src"]
    lookup.select(*names).write.option("header", True).csv(path)
    return files.read_lookup(spark, path, lookup.count()).select(*names[:-1])


_CODES = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(EVENT_TYPES))


@query(
    "ragged_round_trip",
    oracle=f"""SELECT user_id AS row_index, CASE event_type {_CODES} END AS dense_id,
        (date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6 / 3600.0)::FLOAT::DOUBLE AS t, value::FLOAT::DOUBLE AS value FROM events""",
    doubles="t value",
    ints="row_index dense_id",
)
def ragged_round_trip(spark, d):
    """All event records through raw arrays: written in parts by a range sort, read back by byte ranges."""
    path = folder(spark)
    arrays.write_ragged(event_records(spark, d), path)
    return arrays.read_ragged(spark, path)


@query(
    "ragged_unit_counts",
    oracle="SELECT user_id AS row_index, count(*) AS n FROM events GROUP BY user_id",
    ints="row_index n",
)
def ragged_unit_counts(spark, d):
    path = folder(spark)
    arrays.write_ragged(event_records(spark, d), path)
    return arrays.read_ragged(spark, path).groupBy("row_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_round_trip",
    oracle="SELECT count(*) AS n_records, max(user_id) + 1 AS n_stays, 0::BIGINT AS n_wrong FROM events",
    ints="n_records n_stays n_wrong",
)
def manifest_round_trip(spark, d):
    """Counts and digests of the written parts against their manifest."""
    path = folder(spark)
    arrays.write_ragged(event_records(spark, d), path)
    count = lambda name: F.max(F.when(F.col("entry") == name, F.col("found").cast("long"))).alias(name)
    return arrays.manifest_check(spark, path).agg(count("n_records"), count("n_stays"), F.count_if(~F.col("ok")).alias("n_wrong"))
