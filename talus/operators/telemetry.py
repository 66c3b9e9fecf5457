"""Reducers over run and thread telemetry.

``runs`` has one row per measured run, ``threads`` one per worker of a run;
both are joined on run_id. Medians go through ``grouped_quantiles`` so that no
configuration's rows are gathered in one buffer unless they were counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import null_if_sentinel, relative_pct, safe_ratio
from talus.operators.prefix import dense_index
from talus.operators.quantiles import grouped_quantiles, medians
from talus.operators.skew import lag_within
from talus.session import cut_lineage

# Closed sets and rules of the telemetry schema, version 2.
SUPPORTED_VERSIONS = [1, 2]
ENUMS = {
    "partitioner": ["none", "block", "cyclic", "block_cyclic", "nzbalanced", "wbalanced", "contig_opt", "greedy"],
    "schedule": ["precomputed", "static", "static_chunked", "dynamic", "guided", "stealing"],
    "row_order": ["canonical", "sorted_desc", "sorted_asc"],
    "stage_mode": ["serial", "interleave", "mbind"],
    "mempolicy": ["default", "interleave", "bind"],
    "timed_region": ["kernel", "end_to_end"],
    "bitidentical": ["pass", "fail", "skip"],
    "thread_placement": ["socket0", "socket1", "spread", "smt", "unknown"],
}
CHUNKED = ["static_chunked", "dynamic", "guided", "stealing"]
RUNTIME_SCHEDULES = ["dynamic", "guided", "stealing"]
SEAM_BAND = (1.06, 1.16)
CORES_PER_SOCKET = 8
SLOW_THREAD_PCT = -4.0
RAMP_REPETITION = 3
FLAT_RATIO = 2.0
KNEE_SHARE = 0.95


# ----------------------------------------------------------------- validation
def row_problems() -> Column:
    """Array of rule violations of a run row; empty means valid."""
    c = F.col
    rules = [(~c("schema_version").isin(SUPPORTED_VERSIONS), "schema_version")]
    rules.append((F.coalesce(c("csr_variant"), F.lit("")) == "", "csr_variant"))
    for name, allowed in ENUMS.items():
        bad = ~F.coalesce(c(name).isin(allowed), F.lit(False))
        if name == "thread_placement":
            bad = bad & (c("schema_version") >= 2)
        rules.append((bad, name))
    chunked = c("schedule").isin(CHUNKED)
    rules += [
        (chunked & (c("chunk_size") < 1), "chunk_size_missing"),
        (~chunked & (c("chunk_size") != -1), "chunk_size_unexpected"),
        ((c("partitioner") == "none") & ~c("schedule").isin(RUNTIME_SCHEDULES), "partitioner_none"),
        (~c("whitelist_frac").between(0.0, 1.0), "whitelist_frac"),
        ((c("repetition") == 0) != (c("warmup") == 1), "warmup"),
        (c("n_threads") < 1, "n_threads"),
        ((c("n_threads") > 16) & (c("smt") == 0) & (c("platform") == "broadwell"), "smt"),
        (c("k_iterations") < 1, "k_iterations"),
        (c("wall_time_s") <= 0, "wall_time_s"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def validate_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("problems", row_problems())


def problem_counts(runs: DataFrame) -> DataFrame:
    """Violations per rule; ``(valid)`` counts clean rows."""
    named = F.when(F.size("problems") == 0, F.array(F.lit("(valid)"))).otherwise(F.col("problems"))
    return validate_runs(runs).select(F.explode(named).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def measured(runs: DataFrame) -> DataFrame:
    """Runs without warm-up, with the derived measures used by the reducers."""
    notes = F.expr("str_to_map(notes, ';', '=')")
    kept = runs.filter("warmup = 0").withColumn("_note", notes).selectExpr(
        "*",
        "throughput_rec_s / 1e6 AS mrec",
        "CASE WHEN achieved_ghz <> -1 THEN CAST(achieved_ghz AS DOUBLE) END AS _ghz",
        "CASE WHEN l3_tcm <> -1 THEN l3_tcm END AS _l3",
    )
    return kept.selectExpr(
        "*",
        "mrec / _ghz AS mrec_ghz",
        "throughput_rec_s / (_ghz * 1e9) AS rec_per_cycle",
        "time_imbalance / work_imbalance AS contam",
        "n_ranks * n_threads AS p",
        f"n_threads > {CORES_PER_SOCKET} AS seam_expected",
        "_l3 / n_records AS l3_per_rec",
        "_l3 / nullif(l3_tca, 0) AS l3_miss_rate",
        "tot_ins / nullif(tot_cyc, 0) AS ipc",
        "tot_ins / n_records AS ins_per_rec",
        "CAST(_note['tile'] AS INT) AS tile",
        "CAST(_note['pred_eff'] AS DOUBLE) AS pred_eff",
        "CAST(_note['seams'] AS INT) AS seams",
        "_note['exp'] AS exp",
        "_note['variant'] AS variant",
        "CAST(_note['nodes'] AS INT) AS nodes",
        "CAST(_note['per_rank_csr'] AS INT) AS per_rank",
    ).drop("_note", "_ghz", "_l3")


# -------------------------------------------------------------- thread layout
def thread_layout(threads: DataFrame) -> DataFrame:
    """Per run: thread count, socket changes in tid order, layout name."""
    ordered = lag_within(threads.select("run_id", "tid", "socket"), "run_id", "tid", "socket", "before")
    per_run = ordered.groupBy("run_id").agg(
        F.expr("count(1) AS n_tids"),
        F.expr("min(socket) <> max(socket) AS spans_sockets"),
        F.expr("count_if(socket <> before) AS transitions"),
    )
    return per_run.selectExpr(
        "*",
        "CASE WHEN NOT spans_sockets THEN 'single' WHEN transitions <= 1 THEN 'grouped' ELSE 'alternating' END AS layout",
    )


def with_layout(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Folds the layout into thread_placement for runs that span sockets."""
    layout = thread_layout(threads).select("run_id", "layout")
    spans = F.col("thread_placement").isin("spread", "smt")
    named = F.concat_ws("/", "thread_placement", F.coalesce("layout", F.lit("unknown")))
    return runs.join(layout, "run_id", "left").withColumn(
        "thread_placement", F.when(spans, named).otherwise(F.col("thread_placement"))
    )


# ------------------------------------------------------------------- reducers
SUMMARY_KEYS = ["node", "csr_variant", "partitioner", "schedule", "n_threads", "thread_placement", "tile"]


def summarise(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Medians over repetitions and the relative spread per configuration."""
    out = grouped_quantiles(
        runs,
        keys or SUMMARY_KEYS,
        {
            "mrec_s": ("mrec", 0.5),
            "_q1": ("mrec", 0.25),
            "_q3": ("mrec", 0.75),
            "rec_cyc": ("rec_per_cycle", 0.5),
            "ghz": ("achieved_ghz", 0.5),
            "work_imb": ("work_imbalance", 0.5),
            "time_imb": ("time_imbalance", 0.5),
        },
        [F.count(F.lit(1)).alias("n_reps")],
    )
    spread = 100.0 * safe_ratio(F.col("_q3") - F.col("_q1"), F.col("mrec_s"))
    return out.withColumn("iqr_pct", spread).drop("_q1", "_q3")


def modal(df: DataFrame, column: str) -> DataFrame:
    """Most frequent non-NULL value, the smallest one on a tie."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc(column)).limit(1)


def at_modal(df: DataFrame, column: str) -> DataFrame:
    """Rows at the modal value of a column."""
    return df.join(F.broadcast(modal(df, column).select(column)), column, "left_semi")


def scaling(runs: DataFrame, by: str = "n_threads") -> DataFrame:
    """Speed-up and efficiency against the smallest thread count, per step."""
    line = medians(runs, [by], {"mrec": "mrec"})
    whole = Window.orderBy(by)
    base = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    speed = F.col("mrec") / F.first("mrec").over(base)
    return (
        line.withColumn("speedup", speed)
        .withColumn("efficiency", speed * F.first(by).over(base) / F.col(by))
        .withColumn(
            "marginal",
            (F.col("mrec") - F.lag("mrec").over(whole)) / (F.col(by) - F.lag(by).over(whole)),
        )
    )


def node_scaling(runs: DataFrame) -> DataFrame:
    """Multi-node speed-up, efficiency and serial fraction per region/variant."""
    keys = ["exp", "timed_region", "nodes", "variant"]
    out = medians(runs, keys, {"mrec": "mrec", "wall": "wall_time_s", "ghz": "achieved_ghz",
                               "timb": "time_imbalance", "wimb": "work_imbalance"})
    series = Window.partitionBy("exp", "timed_region").orderBy("nodes", "variant").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    p = F.col("nodes") / F.first("nodes").over(series)
    s = F.col("mrec") / F.first("mrec").over(series)
    return (
        out.withColumn("rel_p", p)
        .withColumn("speedup", s)
        .withColumn("efficiency_pct", 100.0 * F.col("speedup") / F.col("rel_p"))
        .withColumn(
            "karp_flatt",
            F.when(
                F.col("rel_p") > 1,
                (1.0 / F.col("speedup") - 1.0 / F.col("rel_p")) / (1.0 - 1.0 / F.when(F.col("rel_p") > 1, F.col("rel_p"))),
            ),
        )
    )


def node_spread(runs: DataFrame) -> DataFrame:
    """Spread of per-node medians within a configuration."""
    keys = ["csr_variant", "partitioner", "schedule", "n_threads"]
    per_node = medians(runs, ["node", *keys], {"mrec": "mrec"})
    across = grouped_quantiles(
        per_node, keys, {"mid": ("mrec", 0.5)},
        [F.min("mrec").alias("lo"), F.max("mrec").alias("hi"), F.count(F.lit(1)).alias("n_nodes")],
    )
    return across.withColumn("spread_pct", 100.0 * safe_ratio(F.col("hi") - F.col("lo"), F.col("mid")))


def half_drift(runs: DataFrame, key: str, repetition: str = "repetition", middle: int = 3) -> DataFrame:
    """Medians of the first and second half of the repetitions and the drift."""
    half = runs.withColumn("half", F.when(F.col(repetition) < middle, "half1").otherwise("half2"))
    long = medians(half, [key, "half"], {"mrec_ghz": "mrec_ghz"})
    wide = long.groupBy(key).pivot("half", ["half1", "half2"]).agg(F.first("mrec_ghz"))
    return wide.withColumn("drift_pct", relative_pct(F.col("half2"), F.col("half1")))


def seam_profile(runs: DataFrame) -> DataFrame:
    """Throughput against the number of socket seams, relative to the best."""
    out = medians(runs, ["seams"], {"mrec_ghz": "mrec_ghz", "ghz": "achieved_ghz",
                                    "work": "work_imbalance", "time": "time_imbalance"})
    best = F.max("mrec_ghz").over(Window.partitionBy())  # one row per seam count
    return out.withColumn("vs_best_pct", relative_pct(F.col("mrec_ghz"), best))


def seam_slow_threads(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Per seam count: threads clearly below the median thread rate."""
    joined = threads.join(runs.select("run_id", "seams"), "run_id").withColumn("rate", F.col("n_records") / F.col("secs"))
    profile = medians(joined, ["seams", "tid"], {"rate": "rate"})
    centre = medians(profile, ["seams"], {"mid": "rate"})
    rel = profile.join(centre, "seams").withColumn("rel", relative_pct(F.col("rate"), F.col("mid")))
    slow = F.col("rel") < SLOW_THREAD_PCT
    return rel.groupBy("seams").agg(
        F.count_if(slow).alias("n_slow"),
        F.min("rel").alias("worst_pct"),
        F.sort_array(F.collect_list(F.when(slow, F.col("tid")))).alias("slow_tids"),
    )


def slowest_threads(threads: DataFrame, min_threads: int) -> DataFrame:
    """Slowest thread of every run, its deficit and the run's layout."""
    threads = cut_lineage(threads.select("run_id", "tid", "cpu", "socket", "n_records", "secs"))
    rated = threads.withColumn("rate", F.col("n_records") / F.col("secs"))
    worst = F.min_by(F.struct("tid", "cpu", "socket", "rate"), F.struct("rate", "tid"))
    per_run = grouped_quantiles(rated, ["run_id"], {"mid": ("rate", 0.5)}, [worst.alias("slow"), F.count(F.lit(1)).alias("n_tids")])
    layout = thread_layout(threads).select("run_id", "transitions")
    order = (
        F.when(F.col("transitions") <= 1, "grouped")
        .when(F.col("transitions") >= F.col("n_tids") - 2, "alternating")
        .otherwise(F.concat(F.lit("other("), F.col("transitions").cast("string"), F.lit(")")))
    )
    return per_run.filter(F.col("n_tids") >= min_threads).join(layout, "run_id").select(
        "run_id",
        "n_tids",
        order.alias("layout"),
        F.col("slow.tid").alias("slow_tid"),
        F.col("slow.cpu").alias("slow_cpu"),
        F.col("slow.socket").alias("slow_socket"),
        relative_pct(F.col("slow.rate"), F.col("mid")).alias("deficit_pct"),
    )


def straggler_summary(threads: DataFrame, min_threads: int) -> DataFrame:
    """Per layout: runs, median deficit and how often each tid is slowest."""
    slow = slowest_threads(threads, min_threads)
    return grouped_quantiles(slow, ["layout", "slow_tid"], {"median_deficit": ("deficit_pct", 0.5)}, [F.count(F.lit(1)).alias("n_runs")])


def relative_rates(threads: DataFrame, by: str, min_threads: int) -> DataFrame:
    """Median thread rate relative to its run's median, per layout and ``by``."""
    threads = cut_lineage(threads.select(*dict.fromkeys(["run_id", "tid", "socket", by, "n_records", "secs"])))
    rated = threads.withColumn("rate", F.col("n_records") / F.col("secs"))
    mids = medians(rated, ["run_id"], {"mid": "rate"})
    layout = thread_layout(threads).filter(F.col("n_tids") >= min_threads).select(
        "run_id", F.when(F.col("transitions") <= 1, "grouped").otherwise("alternating").alias("layout")
    )
    rel = rated.join(mids, "run_id").join(layout, "run_id").withColumn("rel", relative_pct(F.col("rate"), F.col("mid")))
    return medians(rel, ["layout", by], {"rel_pct": "rel"})


def socket_rates(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Per thread count: median thread rate on each socket and tid spread."""
    pre = runs.filter("schedule = 'precomputed'").select("run_id", "n_threads", "time_imbalance")
    joined = threads.join(pre, "run_id").withColumn("rate", F.col("n_records") / F.col("secs") / 1e6)
    joined = joined.withColumn("rate0", F.when(F.col("socket") == 0, F.col("rate"))).withColumn(
        "rate1", F.when(F.col("socket") == 1, F.col("rate"))
    )
    sockets = medians(joined, ["n_threads"], {"s0": "rate0", "s1": "rate1", "time_imb": "time_imbalance"})
    profile = medians(joined, ["n_threads", "tid"], {"rate": "rate"})
    spread = profile.groupBy("n_threads").agg((F.max("rate") / F.min("rate")).alias("max_min_tid"))
    return sockets.join(spread, "n_threads").withColumn("s1_over_s0", safe_ratio(F.col("s1"), F.col("s0")))


def share_correlation(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Precomputed thread speed against the records a dynamic schedule gives it."""
    joined = threads.join(runs.select("run_id", "schedule"), "run_id").withColumn(
        "rate", F.col("n_records") / F.col("secs") / 1e6
    )
    # one pass: values and a mark of each schedule, which is null where a thread number never ran under it
    sides = {"rate": ("precomputed", F.col("rate")), "records": ("dynamic", F.col("n_records"))}
    for name, (schedule, value) in sides.items():
        own = F.col("schedule") == schedule
        joined = joined.withColumn(f"_{name}", F.when(own, value)).withColumn(f"_any_{name}", F.when(own, F.lit(1)))
    wanted = {out: f"_{out}" for name in sides for out in (name, f"any_{name}")}
    both = medians(joined.filter("schedule IN ('precomputed', 'dynamic') AND tid IS NOT NULL"), ["tid"], wanted)
    return both.filter("any_rate IS NOT NULL AND any_records IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_tids"), F.corr("rate", "records").alias("r")
    )


def half_thread_ratio(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Median rate of the upper half of the tids over the lower half."""
    last = threads.groupBy("run_id").agg(F.max("tid").alias("last"))
    joined = threads.join(runs.select("run_id", "n_threads").join(last, "run_id"), "run_id")
    upper = F.col("tid") >= (F.col("last") + 1) / 2
    halves = joined.withColumn("rate", F.col("n_records") / F.col("secs")).withColumn("upper", upper)
    rated = halves.withColumn("lo", F.when(~F.col("upper"), F.col("rate"))).withColumn("hi", F.when(F.col("upper"), F.col("rate")))
    return medians(rated, ["n_threads"], {"lower": "lo", "upper": "hi"}).withColumn(
        "ratio", safe_ratio(F.col("upper"), F.col("lower"))
    )


def granularity(runs: DataFrame) -> DataFrame:
    """Block-size ladder: throughput, step and its mean/straggle parts."""
    t = runs.filter("schedule = 'precomputed'").withColumn("mean_thread", F.col("mrec") * F.col("time_imbalance"))
    ladder = medians(t, ["csr_variant", "tile"], {"mrec": "mrec", "mean_thread": "mean_thread", "time_imb": "time_imbalance"})
    steps = Window.partitionBy("csr_variant").orderBy("tile")

    def step(name: str) -> Column:
        return 100.0 * (F.col(name) / F.lag(name).over(steps) - 1.0)

    straggle = -100.0 * (F.col("time_imb") / F.lag("time_imb").over(steps) - 1.0)
    return (
        ladder.withColumn("step_pct", step("mrec"))
        .withColumn("mean_pp", step("mean_thread"))
        .withColumn("straggle_pp", straggle)
    )


def counter_fit(runs: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least-squares line of y on x and its R^2 per group."""
    pair = runs.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(
        "_x IS NOT NULL AND _y IS NOT NULL"
    )
    return pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
    )


def paired_sign(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Per tid: does the non-interleaved half run faster? Signs and total."""
    joined = threads.join(runs.select("run_id", "per_rank"), "run_id").withColumn("rate", F.col("n_records") / F.col("secs"))
    rates = joined.withColumn("a", F.when(F.col("per_rank") == 0, F.col("rate"))).withColumn(
        "b", F.when(F.col("per_rank") == 1, F.col("rate"))
    )
    return medians(rates, ["tid"], {"shared": "a", "per_rank": "b"}).withColumn(
        "gain_pct", relative_pct(F.col("per_rank"), F.col("shared"))
    ).withColumn("sign", F.signum("gain_pct").cast("int"))


# The interval of an earlier estimate of the remote-memory penalty, in percent.
PENALTY_BAND = (0.79, 1.70)


def paired_halves(pairs: DataFrame, change: str = "gain_pct") -> DataFrame:
    """Mean change of the lower and the upper half of the threads, the penalty they imply, and the sign test.

    ``pairs`` has one row per tid. Both arms expose the same cores the other way
    round, so the lower half should gain and the upper half lose; half the gap of
    the means is the cost of all-remote memory.
    """
    known = pairs.filter(F.col(change).isNotNull())
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)  # one row per tid of one machine
    low = F.col("tid") < F.col("half")
    value = F.col(change)
    sums = known.withColumn("half", half).agg(
        F.max("half").alias("half"),
        F.avg(F.when(low, value)).alias("low_mean"),
        F.avg(F.when(~low, value)).alias("high_mean"),
        F.count_if(low & (value > 0)).alias("low_positive"),
        F.count_if(~low & (value < 0)).alias("high_negative"),
        F.count(F.lit(1)).alias("n_threads"),
    )
    penalty = (F.col("low_mean") - F.col("high_mean")) / 2
    return sums.withColumn("penalty_pct", penalty).withColumn("n_predicted", F.col("low_positive") + F.col("high_negative")).withColumn(
        "consistent", F.col("penalty_pct").between(*PENALTY_BAND)
    )


def partition_sweep(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Measured against predicted imbalance; runs that failed identity drop out."""
    keys = ["p", "partitioner"]
    kept = runs.filter("bitidentical <> 'fail'")
    measured_rows = medians(kept, keys, {"measured": "work_imbalance", "mrec_ghz": "mrec_ghz"}, [F.count(F.lit(1)).alias("n")])
    joined = measured_rows.join(predictions, keys, "left")
    per_p = Window.partitionBy("p")
    base = F.max(F.when(F.col("partitioner") == "block", F.col("mrec_ghz"))).over(per_p)
    base_pred = F.max(F.when(F.col("partitioner") == "block", F.col("pred_imb"))).over(per_p)
    return (
        joined.withColumn("error_pct", relative_pct(F.col("measured"), F.col("pred_imb")))
        .withColumn("vs_best_pct", relative_pct(F.col("mrec_ghz"), F.max("mrec_ghz").over(per_p)))
        .withColumn("gain_pct", relative_pct(F.col("mrec_ghz"), base))
        .withColumn("predicted_gain_pct", relative_pct(base_pred, F.col("pred_imb")))
    )


def inventory(runs: DataFrame) -> DataFrame:
    """Contamination per cell of the experiment grid, with the seam band."""
    keys = ["job_id", "platform", "csr_variant", "partitioner", "schedule", "thread_placement",
            "n_nodes", "n_ranks", "n_threads", "p", "seam_expected"]
    cells = grouped_quantiles(
        runs.filter("timed_region = 'kernel'"), keys, {"median": ("contam", 0.5)},
        [F.min("contam").alias("min"), F.max("contam").alias("max"), F.count(F.lit(1)).alias("n")],
    )
    return cells.withColumn("in_band", F.col("median").between(*SEAM_BAND))


def seam_verdict(runs: DataFrame) -> DataFrame:
    """Do the cells that expect a seam fall into the band, and the others not?"""
    cells = inventory(runs)
    return grouped_quantiles(
        cells, ["seam_expected"], {"median_of_medians": ("median", 0.5)},
        [F.count(F.lit(1)).alias("n_cells"), F.count_if("in_band").alias("n_in_band"),
         F.min("median").alias("lo"), F.max("median").alias("hi"),
         F.count_if(F.col("median").between(0.98, 1.02)).alias("n_near_one")],
    )


def ramp(runs: DataFrame) -> DataFrame:
    """Does contamination follow the clock or the repetition, per job?"""
    order = F.struct("repetition", "run_id")
    settled = runs.withColumn("late", F.when(F.col("repetition") >= RAMP_REPETITION, F.col("contam"))).withColumn(
        "ghz", null_if_sentinel(F.col("achieved_ghz").cast("double"))
    )
    return grouped_quantiles(
        settled, ["job_id"], {"median_all": ("contam", 0.5), "median_late": ("late", 0.5)},
        [
            F.count(F.lit(1)).alias("n"),
            F.corr("contam", "ghz").alias("r_clock"),
            F.corr("contam", F.col("repetition").cast("double")).alias("r_repetition"),
            F.min_by("contam", order).alias("first"),
            F.max_by("contam", order).alias("last"),
        ],
    )


def verdict_table(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Cross table of bit-identity verdicts."""
    return (
        runs.groupBy(*keys).pivot("bitidentical", ENUMS["bitidentical"]).agg(F.count(F.lit(1)))
        .na.fill(0, ENUMS["bitidentical"])
    )


def all_identical(runs: DataFrame) -> DataFrame:
    """Does every judged run of a partitioner pass?"""
    judged = runs.filter("bitidentical <> 'skip'")
    return judged.groupBy("partitioner").agg(
        F.count(F.lit(1)).alias("n_judged"), F.bool_and(F.col("bitidentical") == "pass").alias("all_pass")
    )


def warmup_policy(runs: DataFrame) -> DataFrame:
    """Which repetitions are marked warm-up."""
    return runs.groupBy("warmup").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set("repetition")).alias("repetitions")
    )


def smt_gain(runs: DataFrame) -> DataFrame:
    """Median throughput per placement and thread count, as a table."""
    long = medians(runs, ["n_threads", "thread_placement"], {"mrec_ghz": "mrec_ghz"})
    wide = long.groupBy("n_threads").pivot("thread_placement", ["socket0", "spread", "smt"]).agg(F.first("mrec_ghz"))
    return wide.withColumn("smt_vs_socket0_pct", relative_pct(F.col("smt"), F.col("socket0")))


def best_and_second(runs: DataFrame, key: str = "csr_variant") -> DataFrame:
    """Best rank x thread split per variant, its margin and the overall spread."""
    long = medians(runs, [key, "n_ranks", "n_threads"], {"mrec_ghz": "mrec_ghz"})
    config = F.struct("n_ranks", "n_threads")
    ranked = long.filter("mrec_ghz IS NOT NULL").withColumn(
        "rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mrec_ghz"), "n_ranks", "n_threads"))
    )
    return (
        ranked.groupBy(key)
        .agg(
            F.max_by(config, F.struct(-F.col("rk"))).alias("best"),
            F.max(F.when(F.col("rk") == 1, F.col("mrec_ghz"))).alias("first"),
            F.max(F.when(F.col("rk") == 2, F.col("mrec_ghz"))).alias("second"),
            F.min("mrec_ghz").alias("worst"),
        )
        .select(
            key,
            F.col("best.n_ranks").alias("best_ranks"),
            F.col("best.n_threads").alias("best_threads"),
            relative_pct(F.col("first"), F.col("second")).alias("margin_pct"),
            relative_pct(F.col("first"), F.col("worst")).alias("spread_pct"),
        )
    )


def pooled_effect(runs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Median throughput with and without a binary setting, per group."""
    on_off = runs.withColumn("_off", F.when(F.col(flag) == 0, F.col("mrec_ghz"))).withColumn(
        "_on", F.when(F.col(flag) == 1, F.col("mrec_ghz"))
    )
    return medians(on_off, keys, {"off": "_off", "on": "_on"}).withColumn(
        "gain_pct", relative_pct(F.col("on"), F.col("off"))
    )


def varying_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct) in one pass; constant columns have 1."""
    sums = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return sums.unpivot([], columns, "column", "n_distinct")


def tile_sweep(rows: DataFrame) -> DataFrame:
    """Is throughput flat over tile sizes? Between- against within-tile spread."""
    per_tile = grouped_quantiles(
        rows, ["win", "tile"],
        {"mid": ("records_per_s", 0.5), "q1": ("records_per_s", 0.25), "q3": ("records_per_s", 0.75)},
    ).withColumn("within", F.col("q3") - F.col("q1")).withColumn("log_tile", F.log2(F.col("tile").cast("double")))
    out = grouped_quantiles(
        per_tile, ["win"], {"b1": ("mid", 0.25), "b3": ("mid", 0.75), "within": ("within", 0.5)},
        [F.corr("log_tile", "mid").alias("r_log_tile"), F.count(F.lit(1)).alias("n_tiles")],
    )
    ratio = safe_ratio(F.col("b3") - F.col("b1"), F.col("within"))
    return out.select("win", "n_tiles", ratio.alias("iqr_ratio"), (ratio < FLAT_RATIO).alias("flat"), "r_log_tile")


def roofline(runs: DataFrame, kernel_rate: float) -> DataFrame:
    """Plateau, its 95 % knee and the thread count one core's rate implies."""
    line = medians(runs, ["platform", "n_threads"], {"mrec": "mrec"})
    whole = Window.partitionBy("platform")
    plateau = F.max("mrec").over(whole)
    marked = line.withColumn("plateau", plateau).withColumn(
        "reached", F.when(F.col("mrec") >= KNEE_SHARE * F.col("plateau"), F.col("n_threads"))
    )
    return marked.groupBy("platform").agg(
        F.max("plateau").alias("plateau"), F.min("reached").alias("knee_threads")
    ).withColumn("implied_knee", F.col("plateau") / kernel_rate)


def effects(runs: DataFrame) -> DataFrame:
    """Placement and partition effects per platform from filtered medians."""
    part, place = F.col("partitioner"), F.col("thread_placement")
    spread = (place == "spread") & (F.col("schedule") == "precomputed")
    cells = {
        "t2": (part == "block") & (place == "socket0") & (F.col("n_threads") == 2),
        "t8": (part == "block") & (place == "socket0") & (F.col("n_threads") == 8),
        "b16": (part == "block") & spread & (F.col("n_threads") == 16),
        "c16": (part == "cyclic") & spread & (F.col("n_threads") == 16),
        "g16": (part == "greedy") & spread & (F.col("n_threads") == 16),
        "b12": (part == "block") & spread & (F.col("n_threads") == 12),
        "b14": (part == "block") & spread & (F.col("n_threads") == 14),
        "smt16": (place == "smt") & (F.col("n_threads") == 16),
        "s8": (place == "socket0") & (F.col("n_threads") == 8),
    }
    tagged = reduce(
        lambda df, kv: df.withColumn(f"_{kv[0]}", F.when(kv[1], F.col("mrec_ghz"))), cells.items(), runs
    )
    mids = medians(tagged, ["platform"], {name: f"_{name}" for name in cells})
    return mids.select(
        "platform",
        (100.0 * safe_ratio(F.col("t8") / 4, F.col("t2"))).alias("socket_efficiency_pct"),
        relative_pct(F.col("c16"), F.col("b16")).alias("cyclic_vs_block_pct"),
        relative_pct(F.col("g16"), F.col("b16")).alias("greedy_vs_block_pct"),
        relative_pct(F.col("b14"), F.col("b12")).alias("dip_12_14_pct"),
        relative_pct(F.col("smt16"), F.col("s8")).alias("smt_gain_pct"),
    )


def dose_response(runs: DataFrame, treated: str = "contig_opt", control: str = "block") -> DataFrame:
    """Paired per repetition: treated over control partitioner, per p."""
    cells = medians(
        runs.filter(F.col("partitioner").isin(treated, control)), ["p", "repetition", "partitioner"], {"v": "mrec_ghz"}
    )
    wide = cells.groupBy("p", "repetition").pivot("partitioner", [treated, control]).agg(F.first("v"))
    paired = wide.withColumn("ratio", relative_pct(F.col(treated), F.col(control))).filter("ratio IS NOT NULL")
    return grouped_quantiles(
        paired, ["p"], {"median": ("ratio", 0.5)},
        [F.min("ratio").alias("lo"), F.max("ratio").alias("hi"),
         F.count_if(F.col("ratio") > 0).alias("n_pos"), F.count(F.lit(1)).alias("n_rep")],
    )


def launch_order(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Label processes by launch position; ``ok`` says the label can be trusted.

    ``expected`` is (pos, csr_variant, schedule), one row per planned run.
    """
    pid = F.split_part(F.col("run_id"), F.lit("-"), F.lit(3)).cast("long")
    first = runs.withColumn("pid", pid).groupBy("pid").agg(
        F.min_by(F.struct("csr_variant", "schedule"), F.col("run_id")).alias("got")
    )
    placed = dense_index(first, [F.col("pid")], "pos")
    wanted = expected.select("pos", F.col("csr_variant").alias("want_variant"), F.col("schedule").alias("want_schedule"))
    return placed.join(wanted, "pos", "full").select(
        "pos",
        "pid",
        F.col("got.csr_variant").alias("csr_variant"),
        F.col("got.schedule").alias("schedule"),
        (F.col("got.csr_variant").eqNullSafe(F.col("want_variant"))
         & F.col("got.schedule").eqNullSafe(F.col("want_schedule"))).alias("ok"),
    )


def rolling_median(points: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """Centred rolling median over an ordered series of reduced points."""
    half = width // 2
    frame = Window.orderBy(order).rowsBetween(-half, half - 1 if width % 2 == 0 else half)
    return points.withColumn("rolling", F.percentile(value, F.lit(0.5)).over(frame))


def rank_agreement(points: DataFrame, a: str, b: str) -> DataFrame:
    """Do two measures order a set of reduced points the same way?

    Ties share their average rank, so the comparison ignores row order.
    """
    def average_rank(name: str) -> Column:
        by_value = Window.orderBy(F.desc(name))
        ties = F.count(F.lit(1)).over(Window.partitionBy(name))
        return F.rank().over(by_value) + (ties - 1) / 2.0

    ranked = points.withColumn("rank_a", average_rank(a)).withColumn("rank_b", average_rank(b))
    return ranked.withColumn("agree", F.col("rank_a") == F.col("rank_b"))


def interpolate(points: DataFrame, wanted: DataFrame, x: str, y: str) -> DataFrame:
    """Linear interpolation of (x, y) at the ``wanted`` x values.

    Each pair of neighbouring points becomes one segment and wanted values are
    matched to their segment through the union ordered by x.
    """
    both = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).unionByName(
        wanted.select(F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    )
    order = Window.orderBy("x", F.col("y").isNull())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    filled = both.withColumn("lo", F.last(known, ignorenulls=True).over(back)).withColumn(
        "hi", F.first(known, ignorenulls=True).over(ahead)
    )
    span = F.nullif(F.col("hi.x") - F.col("lo.x"), F.lit(0.0))
    value = F.coalesce(
        F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (F.col("x") - F.col("lo.x")) / span,
        F.when(F.col("lo.x") == F.col("x"), F.col("lo.y")), F.col("lo.y"), F.col("hi.y"),
    )
    return filled.filter("y IS NULL").select(F.col("x").alias(x), value.alias(y))


def against_prediction(runs: DataFrame, predictions: DataFrame, partitioner: str = "block") -> DataFrame:
    """Measured imbalance next to the prediction interpolated at the same p."""
    of_rule = runs.filter(F.col("partitioner") == partitioner)
    seen = medians(of_rule, ["p"], {"measured": "work_imbalance"})
    table = predictions.filter(F.col("partitioner") == partitioner).groupBy("p").agg(F.min("pred_imb").alias("predicted"))
    at = interpolate(table, seen, "p", "predicted")
    return (
        seen.withColumn("p", F.col("p").cast("double")).join(at, "p")
        .withColumn("error_pct", relative_pct(F.col("measured"), F.col("predicted")))
    )


def weighted_share(threads: DataFrame, by: str) -> DataFrame:
    """Record-weighted share of each ``by`` value."""
    sums = threads.groupBy(by).agg(F.sum("n_records").alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def reduce_ranks(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Slowest time and summed records per rank group of a job."""
    joined = threads.join(runs.select("run_id", "job_id", "n_ranks"), "run_id")
    per_run = joined.groupBy("job_id", "n_ranks", "run_id").agg(
        F.max("secs").alias("secs"), F.sum("n_records").alias("records")
    )
    return per_run.groupBy("job_id", "n_ranks").agg(
        F.max("secs").alias("max_secs"), F.sum("records").alias("records"), F.count(F.lit(1)).alias("n_runs")
    )


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Union of telemetry files whose columns differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


