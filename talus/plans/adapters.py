"""The engine's input relations, derived from the shared test tables.

The clinical and telemetry schemas are what the operators work on; on real
data they are read by ``talus.sources``. Here every relation is a projection,
join or grouping of whole test tables, written once in SQL that both Spark
and the oracle engine run, with the two time functions filled in per dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK = {"plus": "timestampadd(SECOND, {s}, {t})", "micros": "timestampdiff(MICROSECOND, {a}, {b})", "lpad": "lpad({x}, 6, '0')"}
DUCKDB = {"plus": "({t} + to_seconds({s}))", "micros": "date_diff('microsecond', {a}, {b})", "lpad": "lpad({x}, 6, '0')"}

# name -> (SQL, relations it needs). plus[t|s] adds s seconds to t.
RELATIONS: dict[str, str] = {
    "icustays": """
        SELECT o_custkey AS subject_id,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN NULL
                    ELSE o_custkey * 100 + (year(o_orderdate) - 1990) END AS hadm_id,
               o_orderkey AS stay_id,
               o_orderpriority AS first_careunit,
               o_orderdate AS intime,
               plus[o_orderdate|CAST(3600 * (1 + floor(o_totalprice / 5000)) AS INT)] AS outtime,
               CAST((1 + floor(o_totalprice / 5000)) / 24e0 AS DOUBLE) AS los
        FROM orders""",
    "patients": """
        SELECT c_custkey AS subject_id,
               CASE WHEN c_nationkey >= 12 THEN 'F' ELSE 'M' END AS gender,
               CAST(10 + 3 * c_nationkey AS INT) AS anchor_age,
               1995 AS anchor_year
        FROM customer""",
    "admissions": """
        SELECT o_custkey AS subject_id,
               o_custkey * 100 + (year(o_orderdate) - 1990) AS hadm_id,
               min(o_orderdate) AS admittime,
               plus[max(o_orderdate)|CAST(floor(10 * (max(o_totalprice) - 30000)) AS INT)] AS dischtime,
               max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS hospital_expire_flag
        FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "diagnoses_icd": """
        SELECT o_custkey AS subject_id,
               o_custkey * 100 + (year(o_orderdate) - 1990) AS hadm_id,
               o_orderpriority AS icd_code
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "d_items": """
        SELECT CAST(1000 + CAST(substr(p_brand, 7) AS INT) AS INT) AS itemid,
               p_brand AS label, min(p_type) AS category,
               CASE WHEN CAST(substr(p_brand, 7) AS INT) >= 20 THEN 'Text' ELSE 'Numeric' END AS param_type
        FROM part GROUP BY p_brand""",
    "d_labitems": """
        SELECT CAST(500 + length(event_type) AS INT) AS itemid,
               min(event_type) AS label, 'lab' AS category
        FROM events GROUP BY length(event_type)""",
    "chartevents": """
        SELECT o_orderkey AS stay_id,
               CAST(1000 + CAST(substr(p_brand, 7) AS INT) AS INT) AS itemid,
               plus[o_orderdate|CAST(floor(1200 * l_quantity * l_linenumber) AS INT)] AS charttime,
               CASE WHEN l_returnflag = 'N' AND l_discount > 0.05 THEN NULL
                    ELSE floor(100 * l_extendedprice / l_quantity) / 1e2 END AS valuenum,
               CASE WHEN l_tax >= 0.07 THEN 1 ELSE 0 END AS warning
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    # chartevents in two parts: the lines with the part for an item, and the items of the parts.
    "chartlines": """
        SELECT o_orderkey AS stay_id, l_partkey AS itemid, plus[o_orderdate|seconds] AS charttime, valuenum
        FROM (SELECT l_orderkey, l_partkey, CAST(floor(1200 * l_quantity * l_linenumber) AS INT) AS seconds,
                     CASE WHEN l_returnflag = 'N' AND l_discount > 0.05 THEN NULL
                          ELSE floor(100 * l_extendedprice / l_quantity) / 1e2 END AS valuenum
              FROM lineitem) AS lines
        JOIN orders ON l_orderkey = o_orderkey""",
    "chartitems": "SELECT p_partkey AS code, CAST(1000 + CAST(substr(p_brand, 7) AS INT) AS INT) AS itemid FROM part",
    "labevents": """
        SELECT CASE WHEN event_type = 'error' THEN NULL
                    ELSE o_custkey * 100 + (year(o_orderdate) - 1990) END AS hadm_id,
               CAST(500 + length(event_type) AS INT) AS itemid,
               plus[o_orderdate|CAST(floor(2000 * value) AS INT)] AS charttime,
               CASE WHEN value < 5 THEN NULL ELSE value END AS valuenum
        FROM events JOIN orders ON event_id = o_orderkey""",
    "varmap": """
        SELECT concat('v', CAST((itemid - 1000) % 5 AS VARCHAR(20))) AS variable, itemid, 'chart' AS src,
               CASE WHEN (itemid - 1000) % 5 < 3 THEN 'core' ELSE 'pool' END AS tier,
               CASE WHEN (itemid - 1000) % 5 < 3 THEN 0 ELSE (itemid - 1000) % 5 END AS pref,
               CASE WHEN category = 'PROMO' THEN 5e-1 ELSE 1e0 END AS vscale,
               CASE WHEN category = 'PROMO' THEN -17e0 ELSE 0e0 END AS voffset,
               1000e0 + itemid - 1000 AS raw_lo, 1950e0 AS raw_hi
        FROM d_items
        UNION ALL
        SELECT concat('lab_', label) AS variable, itemid, 'lab' AS src, 'pool' AS tier,
               itemid - 480 AS pref, 1e0 AS vscale, 0e0 AS voffset, 0e0 AS raw_lo, 250e0 AS raw_hi
        FROM d_labitems""",
    "runs": """
        SELECT 2 AS schema_version,
               concat(CAST(70000 + o_orderkey % 5 AS VARCHAR(20)), '-0-', CAST(CAST(floor(o_orderkey / 6) AS BIGINT) AS VARCHAR(20)),
                      '-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS run_id,
               70000 + o_orderkey % 5 AS job_id,
               concat('c', CAST(o_custkey % 4 AS VARCHAR(20)), '.local') AS node,
               CASE WHEN o_orderstatus = 'O' THEN 'Wfull' ELSE 'W24' END AS csr_variant,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'mpi' ELSE 'omp' END AS paradigm,
               CASE WHEN o_custkey % 2 = 0 THEN 'broadwell' ELSE 'sandybridge' END AS platform,
               CASE o_custkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'block' WHEN 2 THEN 'cyclic'
                    WHEN 3 THEN 'nzbalanced' WHEN 4 THEN 'contig_opt' WHEN 5 THEN 'greedy' ELSE 'block' END AS partitioner,
               CASE WHEN o_orderkey % 3 = 0 THEN 'dynamic' ELSE 'precomputed' END AS schedule,
               CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE -1 END AS chunk_size,
               'canonical' AS row_order,
               CAST(1 + o_custkey % 4 AS INT) AS n_ranks,
               CASE o_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 WHEN 4 THEN 14 ELSE 16 END AS n_threads,
               CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS smt,
               CASE o_orderkey % 4 WHEN 0 THEN 'socket0' WHEN 1 THEN 'spread' WHEN 2 THEN 'smt' ELSE 'spread' END AS thread_placement,
               CAST(1 + o_custkey % 5 AS INT) AS n_nodes,
               'interleave' AS stage_mode, 'default' AS mempolicy,
               CASE WHEN o_totalprice > 480000 THEN 1.5e0 ELSE 1e0 END AS whitelist_frac,
               1 AS k_iterations,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'end_to_end' ELSE 'kernel' END AS timed_region,
               CAST(floor(o_orderkey / 5) % 6 AS INT) AS repetition,
               CASE WHEN floor(o_orderkey / 5) % 6 = 0 THEN 1 ELSE 0 END AS warmup,
               o_totalprice / 1e5 AS wall_time_s,
               (1000000 + 1000 * o_custkey) / (o_totalprice / 1e5) AS throughput_rec_s,
               1 + (o_orderkey % 97) / 1e3 AS work_imbalance,
               (1 + (o_orderkey % 97) / 1e3) * (1 + (o_custkey % 19) / 1e2) AS time_imbalance,
               1000000 + 1000 * o_custkey AS n_records,
               CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'P' THEN 'fail' ELSE 'skip' END AS bitidentical,
               CASE WHEN o_custkey % 11 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS l3_tcm,
               CAST(floor(3 * o_totalprice) + 7 AS BIGINT) AS l3_tca,
               CAST(floor(1000 * o_totalprice) AS BIGINT) AS tot_cyc,
               25 * (1000000 + 1000 * o_custkey) AS tot_ins,
               CASE WHEN o_custkey % 13 = 0 THEN -1e0 ELSE 2e0 + (o_orderkey % 10) / 1e1 END AS achieved_ghz,
               concat('tile=', CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 1024 ELSE 4096 END AS VARCHAR(20)),
                      ';pred_eff=0.', CAST(90 + o_custkey % 10 AS VARCHAR(20)),
                      ';seams=', CAST(1 + 2 * (o_custkey % 8) AS VARCHAR(20)),
                      ';exp=', CASE WHEN o_custkey % 2 = 0 THEN 'strong' ELSE 'weak' END,
                      ';variant=', CASE WHEN o_orderstatus = 'O' THEN 'Wfull' ELSE 'W24' END,
                      ';nodes=', CAST(1 + o_custkey % 5 AS VARCHAR(20)),
                      ';per_rank_csr=', CAST(o_orderkey % 2 AS VARCHAR(20)),
                      ';p=', CAST(16 * (1 + o_custkey % 5) AS VARCHAR(20))) AS notes
        FROM orders""",
    "threads": """
        SELECT 2 AS schema_version,
               concat(CAST(70000 + l_orderkey % 5 AS VARCHAR(20)), '-0-', CAST(CAST(floor(l_orderkey / 6) AS BIGINT) AS VARCHAR(20)),
                      '-', lpad(CAST(l_orderkey AS VARCHAR(20)), 9, '0')) AS run_id,
               CAST(l_linenumber - 1 AS INT) AS tid,
               CAST(min(l_suppkey) % 16 AS INT) AS cpu,
               CASE WHEN min(l_suppkey) % 16 >= 8 THEN 1 ELSE 0 END AS socket,
               count(*) AS n_stays,
               CAST(floor(1000 * sum(l_quantity)) AS BIGINT) AS n_records,
               CAST(sum(CAST(floor(100 * l_extendedprice) AS BIGINT)) AS DOUBLE) / 1e7 AS secs
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "predictions": """
        SELECT partitioner, p, 1e0 + 1e-2 * length(partitioner) + p / 1e3 AS pred_imb
        FROM (SELECT partitioner, CAST(n_ranks * n_threads AS INT) AS p FROM runs) GROUP BY partitioner, p""",
    "tile_runs": """
        SELECT CASE WHEN event_type IN ('click', 'view') THEN 'W24' ELSE 'Wfull' END AS win,
               CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 1024 ELSE 4096 END AS tile,
               CAST(event_id % 5 AS INT) AS rep, 100 * value + 1000 AS records_per_s
        FROM events""",
    "scores": """
        SELECT documents.doc_id, source AS subject, quality AS y,
               n_chars / (n_chars + 15e2) AS score
        FROM documents JOIN labels ON documents.doc_id = labels.doc_id""",
    "units_doc": "SELECT doc_id AS idx, n_chars AS n FROM documents",
    "unit_events": """
        SELECT user_id AS unit, event_type, ts, value, props FROM events""",
}

# The same rows for Spark where joins would carry more columns of the larger table than the result needs.
SPARK_FORMS: dict[str, str] = {
    "chartevents": """
        SELECT o_orderkey AS stay_id, itemid, plus[o_orderdate|CAST(floor(seconds) AS INT)] AS charttime, valuenum, warning
        FROM (SELECT l_orderkey, l_partkey, 1200 * l_quantity * l_linenumber AS seconds,
                     CASE WHEN l_returnflag = 'N' AND l_discount > 0.05 THEN NULL
                          ELSE floor(100 * l_extendedprice / l_quantity) / 1e2 END AS valuenum,
                     CASE WHEN l_tax >= 0.07 THEN 1 ELSE 0 END AS warning
              FROM lineitem) AS lines
        JOIN orders ON l_orderkey = o_orderkey
        JOIN (SELECT p_partkey, CAST(1000 + CAST(substr(p_brand, 7) AS INT) AS INT) AS itemid FROM part) AS items ON l_partkey = p_partkey""",
    "labevents": """
        SELECT CASE WHEN failed THEN NULL
                    ELSE o_custkey * 100 + (year(o_orderdate) - 1990) END AS hadm_id,
               itemid, plus[o_orderdate|CAST(floor(seconds) AS INT)] AS charttime, valuenum
        FROM (SELECT event_id, event_type = 'error' AS failed, CAST(500 + length(event_type) AS INT) AS itemid,
                     2000 * value AS seconds, CASE WHEN value < 5 THEN NULL ELSE value END AS valuenum
              FROM events) AS measured
        JOIN orders ON event_id = o_orderkey""",
}

_NEEDS = {"predictions": ["runs"], "varmap": ["d_items", "d_labitems"]}


def render(name: str, dialect: dict[str, str]) -> str:
    sql = re.sub(
        r"plus\[(.*?)\|(.*?)\](?= AS)",
        lambda m: dialect["plus"].format(t=m[1], s=m[2]),
        SPARK_FORMS.get(name, RELATIONS[name]) if dialect is SPARK else RELATIONS[name],
    )
    if dialect is SPARK:  # Spark concat keeps char padding only with STRING
        sql = sql.replace("VARCHAR(20)", "STRING")
    return sql


def oracle_prefix(*names: str) -> str:
    """WITH clause defining the named relations for the oracle engine."""
    ordered: list[str] = []
    for name in names:
        for dep in [*_NEEDS.get(name, []), name]:
            if dep not in ordered:
                ordered.append(dep)
    return "WITH " + ", ".join(f"{n} AS ({render(n, DUCKDB)})" for n in ordered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived relation as a DataFrame over whole test tables, or over what is ``given`` for some."""
    sql = render(name, SPARK)
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    used.update({dep: relation(spark, sf_dir, dep) for dep in _NEEDS.get(name, [])})
    for alias in used:
        sql = re.sub(rf"\b(FROM|JOIN) {alias}\b", rf"\1 {{{alias}}} AS {alias}", sql)
    return spark.sql(sql, **used)
