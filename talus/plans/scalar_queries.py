"""Scalar functions, reshaping and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import scalars as sc
from talus.operators.bootstrap import cross_check
from talus.operators.partitioners import cyclic_loads
from talus.plans.adapters import oracle_prefix, relation, table
from talus.plans.registry import query


@query(
    "time_functions",
    oracle="""SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 / 3600.0 AS hours,
        date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 / 86400.0 AS days, year(ts) AS y FROM events""",
    doubles="hours days",
    ints="y",
)
def time_functions(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "event_id",
        sc.hours_between(start, F.col("ts")).alias("hours"),
        sc.days_between(start, F.col("ts")).alias("days"),
        F.year("ts").alias("y"),
    )


@query(
    "value_functions",
    oracle="""SELECT event_id, greatest(5, least(50, value)) AS clipped, value * 0.5555555555555556 - 17.77777777777778 AS harmonised,
        round(value, 1) AS rounded, ln(1 + value) AS l1p, exp(value / 100) - 1 AS em1, sqrt(value) AS root, log2(value) AS lg,
        value > 1 AND value < 100 AS plausible, CASE WHEN value <= 5 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS bin FROM events""",
    doubles="clipped harmonised rounded l1p em1 root lg",
)
def value_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        sc.clip(v, F.lit(5.0), F.lit(50.0)).alias("clipped"),
        sc.harmonise(v, F.lit(0.5555555555555556), F.lit(-17.77777777777778)).alias("harmonised"),
        F.round(v, 1).alias("rounded"),
        F.log1p(v).alias("l1p"),
        F.expm1(v / 100).alias("em1"),
        F.sqrt(v).alias("root"),
        F.log2(v).alias("lg"),
        ((v > 1) & (v < 100)).alias("plausible"),
        sc.right_closed_bin(v, [-1.0, 5.0, 50.0, float("inf")], ["low", "mid", "high"]).alias("bin"),
    )


@query(
    "finite_filter",
    oracle="SELECT count(*) AS n, count(*) FILTER (WHERE isfinite(value)) AS n_finite, count(*) FILTER (WHERE event_type LIKE 'c%') AS n_like FROM events",
)
def finite_filter(spark, d):
    return table(spark, d, "events").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sc.is_finite(F.col("value"))).alias("n_finite"),
        F.count_if(F.col("event_type").like("c%")).alias("n_like"),
    )


@query(
    "json_props",
    oracle="""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum,
        min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_min FROM events GROUP BY event_type""",
    ints="k_sum k_min",
)
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.min(k).alias("k_min")
    )


@query(
    "note_parsing",
    oracle=oracle_prefix("runs") + """ SELECT run_id, nullif(regexp_extract(notes, '(?:^|;)seams=([^;]*)', 1), '') AS seams,
        nullif(regexp_extract(notes, '(?:^|;)missing=([^;]*)', 1), '') AS missing, split_part(run_id, '-', 3) AS pid,
        split_part(node, '.', 1) AS host, replace(replace(notes, ',', ';'), chr(10), ' ') AS clean, contains(node, 'c1') AS is_c1 FROM runs""",
)
def note_parsing(spark, d):
    return relation(spark, d, "runs").select(
        "run_id",
        sc.note_value(F.col("notes"), "seams").alias("seams"),
        sc.note_value(F.col("notes"), "missing").alias("missing"),
        F.split_part("run_id", F.lit("-"), F.lit(3)).alias("pid"),
        F.split_part("node", F.lit("."), F.lit(1)).alias("host"),
        sc.sanitise_note(F.col("notes")).alias("clean"),
        F.col("node").contains("c1").alias("is_c1"),
    )


@query(
    "divisors",
    oracle="SELECT p_size, count(*) AS n_parts, list_aggregate([x FOR x IN range(1, 17) IF p_size % x = 0], 'count') AS n_divisors FROM part GROUP BY p_size",
)
def divisors(spark, d):
    sizes = table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n_parts"))
    split = sizes.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(16)))).filter("p_size % t = 0")
    return split.groupBy("p_size", "n_parts").agg(F.count(F.lit(1)).alias("n_divisors"))


@query(
    "size_sorted_order",
    oracle="SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents",
)
def size_sorted_order(spark, d):
    from talus.operators.prefix import dense_index

    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return dense_index(docs, [F.desc("n_chars"), F.asc("doc_id")], "pos").select("doc_id", "n_chars", "pos")


@query(
    "dedupe_signature",
    oracle="""SELECT vector, n_units, n_records FROM (SELECT *, row_number() OVER (PARTITION BY n_units, n_records ORDER BY vector) AS rn FROM (
        SELECT p_brand AS vector, count(*) AS n_units, sum(p_size) AS n_records FROM part GROUP BY p_brand)) WHERE rn = 1""",
    ints="n_records",
)
def dedupe_signature(spark, d):
    sizes = table(spark, d, "part").groupBy(F.col("p_brand").alias("vector")).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("p_size").alias("n_records")
    )
    first = F.row_number().over(Window.partitionBy("n_units", "n_records").orderBy("vector"))
    return sizes.withColumn("rn", first).filter("rn = 1").drop("rn")


@query(
    "set_difference",
    oracle="SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events",
)
def set_difference(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(users, "c_custkey", "left_anti")


@query(
    "unpivot_compare",
    oracle="""WITH l AS (SELECT p, doc_id % p AS w, sum(n_chars) AS load FROM documents, (VALUES (16), (32)) AS g(p) GROUP BY 1, 2)
      SELECT count(*) AS n_pairs, 0 AS max_gap, 0.0 AS rms_gap, 0 AS n_outside FROM l""",
    doubles="rms_gap",
    ints="max_gap n_outside",
)
def unpivot_compare(spark, d):
    """Two routes to cyclic loads: long form, and a wide form melted back."""
    from talus.plans.skew_queries import doc_units

    units = doc_units(spark, d)
    long = cyclic_loads(units, [16, 32])
    wide = units.agg(
        *[F.sum(F.when(F.pmod("idx", F.lit(p)) == w, F.col("n"))).alias(f"{p}_{w}") for p in (16, 32) for w in range(p)]
    )
    melted = wide.unpivot([], wide.columns, "cell", "load").select(
        F.split_part("cell", F.lit("_"), F.lit(1)).cast("long").alias("p"),
        F.split_part("cell", F.lit("_"), F.lit(2)).cast("long").alias("worker"),
        "load",
    )
    return cross_check(long, melted, ["p", "worker"], "load")


@query(
    "scalar_subquery_share",
    oracle="""SELECT c_mktsegment, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS share,
        count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal > 0) AS n_nations FROM customer GROUP BY c_mktsegment""",
    doubles="share",
)
def scalar_subquery_share(spark, d):
    customers = table(spark, d, "customer")
    everyone = customers.agg(F.count(F.lit(1)).alias("total"))
    return (
        customers.groupBy("c_mktsegment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).alias("n_nations"),
        )
        .crossJoin(everyone)  # one row
        .select("c_mktsegment", "n", (F.col("n") / F.col("total")).alias("share"), "n_nations")
    )


@query(
    "dictionary_enrichment",
    oracle="""SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
      LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def dictionary_enrichment(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return (
        table(spark, d, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", "s_name", "n_name", "r_name")
    )


@query(
    "interval_quantiles",
    oracle="""SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3,
        100 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / median(value) AS iqr_pct FROM events GROUP BY event_type""",
    doubles="q1 q2 q3 iqr_pct",
)
def interval_quantiles(spark, d):
    from talus.operators.quantiles import grouped_quantiles

    q = grouped_quantiles(
        table(spark, d, "events"), ["event_type"],
        {"q1": ("value", 0.25), "q2": ("value", 0.5), "q3": ("value", 0.75)},
    )
    return q.withColumn("iqr_pct", 100.0 * (F.col("q3") - F.col("q1")) / F.col("q2"))


@query(
    "ranged_quantiles",
    oracle="SELECT l_returnflag, quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi FROM lineitem GROUP BY l_returnflag",
    doubles="lo hi",
)
def ranged_quantiles(spark, d):
    """Far quantiles of a few groups that hold all rows."""
    from talus.operators.quantiles import grouped_quantiles

    return grouped_quantiles(
        table(spark, d, "lineitem"), ["l_returnflag"],
        {"lo": ("l_extendedprice", 0.001), "hi": ("l_extendedprice", 0.999)},
    )


@query(
    "modal_value",
    oracle="SELECT l_returnflag, mode(l_linenumber ORDER BY l_linenumber) AS m FROM (SELECT l_returnflag, l_linenumber FROM lineitem) GROUP BY 1",
    ints="m",
)
def modal_value(spark, d):
    """Mode per group with the smallest value on a tie, from counted values."""
    counted = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("l_linenumber", F.struct(-F.col("n"), F.col("l_linenumber")))
    return counted.groupBy("l_returnflag").agg(best.alias("m"))


