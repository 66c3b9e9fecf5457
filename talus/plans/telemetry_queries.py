"""Telemetry validation and reducers."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import telemetry as te
from talus.plans.adapters import oracle_prefix, relation, table
from talus.plans.registry import query

MIN_THREADS = 4


def runs(spark, d):
    return relation(spark, d, "runs")


def measured(spark, d):
    return te.measured(runs(spark, d))


def threads(spark, d):
    return relation(spark, d, "threads")


def _note(key: str, kind: str) -> str:
    return f"CAST(nullif(regexp_extract(notes, '(?:^|;){key}=([^;]*)', 1), '') AS {kind}) AS {key}"


RUNS_SQL = oracle_prefix("runs", "threads", "predictions") + f""",
base AS (
  SELECT *, throughput_rec_s / 1e6 AS mrec, CASE WHEN achieved_ghz <> -1 THEN achieved_ghz END AS ghz,
         time_imbalance / work_imbalance AS contam, CAST(n_ranks * n_threads AS BIGINT) AS p, n_threads > 8 AS seam_expected,
         CASE WHEN l3_tcm <> -1 THEN l3_tcm END AS l3,
         {_note('tile', 'INT')}, {_note('pred_eff', 'DOUBLE')}, {_note('seams', 'INT')}, {_note('exp', 'VARCHAR')},
         {_note('variant', 'VARCHAR')}, {_note('nodes', 'INT')}, {_note('per_rank_csr', 'INT')}
  FROM runs WHERE warmup = 0),
m AS (SELECT *, mrec / ghz AS mrec_ghz, throughput_rec_s / (ghz * 1e9) AS rec_per_cycle, l3::DOUBLE / n_records AS l3_per_rec,
             l3::DOUBLE / nullif(l3_tca, 0) AS l3_miss_rate, tot_ins::DOUBLE / nullif(tot_cyc, 0) AS ipc,
             tot_ins::DOUBLE / n_records AS ins_per_rec FROM base),
rated AS (SELECT *, n_records / secs AS rate FROM threads),
shape AS (
  SELECT run_id, count(*) AS n_tids, count(DISTINCT socket) > 1 AS spans_sockets, coalesce(sum(CASE WHEN socket <> prev THEN 1 ELSE 0 END), 0) AS transitions
  FROM (SELECT *, lag(socket) OVER (PARTITION BY run_id ORDER BY tid) AS prev FROM threads) GROUP BY run_id),
layout AS (SELECT *, CASE WHEN NOT spans_sockets THEN 'single' WHEN transitions <= 1 THEN 'grouped' ELSE 'alternating' END AS layout FROM shape)"""


PROBLEMS_SQL = oracle_prefix("runs") + """, flags AS (
      SELECT run_id, list_filter([
        CASE WHEN schema_version NOT IN (1, 2) THEN 'schema_version' END,
        CASE WHEN coalesce(csr_variant, '') = '' THEN 'csr_variant' END,
        CASE WHEN NOT coalesce(schedule IN ('precomputed','static','static_chunked','dynamic','guided','stealing'), false) THEN 'schedule' END,
        CASE WHEN NOT coalesce(bitidentical IN ('pass','fail','skip'), false) THEN 'bitidentical' END,
        CASE WHEN schedule IN ('static_chunked','dynamic','guided','stealing') AND chunk_size < 1 THEN 'chunk_size_missing' END,
        CASE WHEN schedule NOT IN ('static_chunked','dynamic','guided','stealing') AND chunk_size <> -1 THEN 'chunk_size_unexpected' END,
        CASE WHEN partitioner = 'none' AND schedule NOT IN ('dynamic','guided','stealing') THEN 'partitioner_none' END,
        CASE WHEN NOT whitelist_frac BETWEEN 0 AND 1 THEN 'whitelist_frac' END,
        CASE WHEN (repetition = 0) <> (warmup = 1) THEN 'warmup' END,
        CASE WHEN n_threads < 1 THEN 'n_threads' END,
        CASE WHEN n_threads > 16 AND smt = 0 AND platform = 'broadwell' THEN 'smt' END,
        CASE WHEN wall_time_s <= 0 THEN 'wall_time_s' END], lambda x: x IS NOT NULL) AS problems FROM runs)"""


@query(
    "run_problems",
    oracle=PROBLEMS_SQL + """
      SELECT rule, count(*) AS n FROM (
        SELECT unnest(CASE WHEN len(problems) = 0 THEN ['(valid)'] ELSE problems END) AS rule FROM flags) GROUP BY rule""",
)
def run_problems(spark, d):
    return te.problem_counts(runs(spark, d))


@query(
    "derived_measures",
    oracle=RUNS_SQL + """ SELECT run_id, mrec, mrec_ghz, rec_per_cycle, contam, p, seam_expected, l3_per_rec, l3_miss_rate, ipc, ins_per_rec,
        tile, pred_eff, seams, exp, variant, nodes FROM m""",
    doubles="mrec mrec_ghz rec_per_cycle contam l3_per_rec l3_miss_rate ipc ins_per_rec pred_eff",
    ints="p tile seams nodes",
    digits=10,
)
def derived_measures(spark, d):
    return measured(spark, d).select(
        "run_id", "mrec", "mrec_ghz", "rec_per_cycle", "contam", "p", "seam_expected", "l3_per_rec", "l3_miss_rate", "ipc",
        "ins_per_rec", "tile", "pred_eff", "seams", "exp", "variant", "nodes",
    )


@query(
    "thread_layout",
    oracle=RUNS_SQL + " SELECT * FROM layout",
    ints="transitions",
)
def thread_layout(spark, d):
    return te.thread_layout(threads(spark, d))


@query(
    "config_summary",
    oracle=RUNS_SQL + """, placed AS (SELECT m.* EXCLUDE thread_placement, CASE WHEN thread_placement IN ('spread', 'smt')
        THEN concat(thread_placement, '/', coalesce(layout, 'unknown')) ELSE thread_placement END AS thread_placement
        FROM m LEFT JOIN layout ON layout.run_id = m.run_id)
      SELECT node, csr_variant, partitioner, schedule, n_threads, thread_placement, tile, count(*) AS n_reps, median(mrec) AS mrec_s,
        median(rec_per_cycle) AS rec_cyc, median(achieved_ghz) AS ghz, median(work_imbalance) AS work_imb, median(time_imbalance) AS time_imb,
        100 * (quantile_cont(mrec, 0.75) - quantile_cont(mrec, 0.25)) / median(mrec) AS iqr_pct
      FROM placed GROUP BY node, csr_variant, partitioner, schedule, n_threads, thread_placement, tile""",
    doubles="mrec_s rec_cyc ghz work_imb time_imb iqr_pct",
    ints="n_threads tile",
)
def config_summary(spark, d):
    return te.summarise(te.with_layout(measured(spark, d), threads(spark, d)))


@query(
    "modal_tile",
    oracle=RUNS_SQL + " SELECT tile, count(*) AS n FROM m WHERE tile IS NOT NULL GROUP BY tile ORDER BY n DESC, tile LIMIT 1",
    ints="tile",
)
def modal_tile(spark, d):
    return te.modal(measured(spark, d), "tile")


@query(
    "rows_at_modal_placement",
    oracle=RUNS_SQL + """ SELECT n_threads, count(*) AS n FROM m WHERE thread_placement = (SELECT thread_placement FROM m
        GROUP BY thread_placement ORDER BY count(*) DESC, thread_placement LIMIT 1) GROUP BY n_threads""",
    ints="n_threads",
)
def rows_at_modal_placement(spark, d):
    return te.at_modal(measured(spark, d), "thread_placement").groupBy("n_threads").agg(F.count(F.lit(1)).alias("n"))


@query(
    "thread_scaling",
    oracle=RUNS_SQL + """, line AS (SELECT n_threads, median(mrec) AS mrec FROM m GROUP BY n_threads)
      SELECT n_threads, mrec, mrec / first_value(mrec) OVER w AS speedup,
        mrec / first_value(mrec) OVER w * first_value(n_threads) OVER w / n_threads AS efficiency,
        (mrec - lag(mrec) OVER w) / (n_threads - lag(n_threads) OVER w) AS marginal
      FROM line WINDOW w AS (ORDER BY n_threads)""",
    doubles="mrec speedup efficiency marginal",
    ints="n_threads",
)
def thread_scaling(spark, d):
    return te.scaling(measured(spark, d))


@query(
    "node_scaling",
    oracle=RUNS_SQL + """, g AS (SELECT exp, timed_region, nodes, variant, median(mrec) AS mrec, median(wall_time_s) AS wall,
          median(achieved_ghz) AS ghz, median(time_imbalance) AS timb, median(work_imbalance) AS wimb FROM m GROUP BY 1, 2, 3, 4),
      s AS (SELECT *, nodes::DOUBLE / first_value(nodes) OVER w AS rel_p, mrec / first_value(mrec) OVER w AS speedup FROM g
            WINDOW w AS (PARTITION BY exp, timed_region ORDER BY nodes, variant))
      SELECT *, 100 * speedup / rel_p AS efficiency_pct,
        CASE WHEN rel_p > 1 THEN (1 / speedup - 1 / rel_p) / (1 - 1 / rel_p) END AS karp_flatt FROM s""",
    doubles="mrec wall ghz timb wimb rel_p speedup efficiency_pct karp_flatt",
    ints="nodes",
)
def node_scaling(spark, d):
    return te.node_scaling(measured(spark, d))


@query(
    "node_spread",
    oracle=RUNS_SQL + """, pn AS (SELECT node, csr_variant, partitioner, schedule, n_threads, median(mrec) AS mrec FROM m GROUP BY 1, 2, 3, 4, 5)
      SELECT csr_variant, partitioner, schedule, n_threads, min(mrec) AS lo, max(mrec) AS hi, count(*) AS n_nodes, median(mrec) AS mid,
        100 * (max(mrec) - min(mrec)) / median(mrec) AS spread_pct FROM pn GROUP BY 1, 2, 3, 4""",
    doubles="lo hi mid spread_pct",
    ints="n_threads",
)
def node_spread(spark, d):
    return te.node_spread(measured(spark, d))


@query(
    "half_drift",
    oracle=RUNS_SQL + """ SELECT partitioner, half1, half2, 100 * (half2 / half1 - 1) AS drift_pct FROM (
        SELECT partitioner, median(mrec_ghz) FILTER (WHERE repetition < 3) AS half1,
               median(mrec_ghz) FILTER (WHERE repetition >= 3) AS half2 FROM m GROUP BY partitioner)""",
    doubles="half1 half2 drift_pct",
)
def half_drift(spark, d):
    return te.half_drift(measured(spark, d), "partitioner")


@query(
    "seam_profile",
    oracle=RUNS_SQL + """ SELECT seams, mrec_ghz, ghz, work, "time", 100 * (mrec_ghz / max(mrec_ghz) OVER () - 1) AS vs_best_pct FROM (
        SELECT seams, median(mrec_ghz) AS mrec_ghz, median(achieved_ghz) AS ghz, median(work_imbalance) AS work,
               median(time_imbalance) AS "time" FROM m GROUP BY seams)""",
    doubles="mrec_ghz ghz work time vs_best_pct",
    ints="seams",
)
def seam_profile(spark, d):
    return te.seam_profile(measured(spark, d))


@query(
    "seam_slow_threads",
    oracle=RUNS_SQL + """, prof AS (SELECT seams, tid, median(rate) AS rate FROM rated JOIN m USING (run_id) GROUP BY 1, 2),
      rel AS (SELECT *, 100 * (rate / median(rate) OVER (PARTITION BY seams) - 1) AS rel FROM prof)
      SELECT seams, count(*) FILTER (WHERE rel < -4) AS n_slow, min(rel) AS worst_pct FROM rel GROUP BY seams""",
    doubles="worst_pct",
    ints="seams",
)
def seam_slow_threads(spark, d):
    return te.seam_slow_threads(measured(spark, d), threads(spark, d)).drop("slow_tids")


_SLOW_SQL = RUNS_SQL + f""", pr AS (SELECT run_id, median(rate) AS mid, count(*) AS n_tids, min(rate) AS low FROM rated GROUP BY run_id),
  sl AS (SELECT run_id, arg_min(tid, (rate, tid)) AS slow_tid, arg_min(cpu, (rate, tid)) AS slow_cpu, arg_min(socket, (rate, tid)) AS slow_socket
         FROM rated GROUP BY run_id),
  slowest AS (SELECT run_id, pr.n_tids, CASE WHEN transitions <= 1 THEN 'grouped' WHEN transitions >= pr.n_tids - 2 THEN 'alternating'
                ELSE concat('other(', transitions, ')') END AS layout, slow_tid, slow_cpu, slow_socket, 100 * (low / mid - 1) AS deficit_pct
              FROM pr JOIN sl USING (run_id) JOIN shape USING (run_id) WHERE pr.n_tids >= {MIN_THREADS})"""


@query(
    "slowest_threads",
    oracle=_SLOW_SQL + " SELECT * FROM slowest",
    doubles="deficit_pct",
    ints="slow_tid slow_cpu slow_socket",
)
def slowest_threads(spark, d):
    return te.slowest_threads(threads(spark, d), MIN_THREADS)


@query(
    "straggler_summary",
    oracle=_SLOW_SQL + " SELECT layout, slow_tid, count(*) AS n_runs, median(deficit_pct) AS median_deficit FROM slowest GROUP BY 1, 2",
    doubles="median_deficit",
    ints="slow_tid",
)
def straggler_summary(spark, d):
    return te.straggler_summary(threads(spark, d), MIN_THREADS)


@query(
    "relative_rates_by_cpu",
    oracle=RUNS_SQL + f""", rel AS (SELECT cpu, CASE WHEN transitions <= 1 THEN 'grouped' ELSE 'alternating' END AS layout,
          100 * (rate / median(rate) OVER (PARTITION BY run_id) - 1) AS rel FROM rated JOIN shape USING (run_id) WHERE n_tids >= {MIN_THREADS})
      SELECT layout, cpu, median(rel) AS rel_pct FROM rel GROUP BY 1, 2""",
    doubles="rel_pct",
    ints="cpu",
)
def relative_rates_by_cpu(spark, d):
    return te.relative_rates(threads(spark, d), "cpu", MIN_THREADS)


_PRE_SQL = RUNS_SQL + """, pre AS (SELECT r.*, m.n_threads, m.time_imbalance, m.schedule, rate / 1e6 AS mrate FROM rated r JOIN m USING (run_id))"""


@query(
    "socket_rates",
    oracle=_PRE_SQL + """, tidp AS (SELECT n_threads, tid, median(mrate) AS mrate FROM pre WHERE schedule = 'precomputed' GROUP BY 1, 2)
      SELECT n_threads, s0, s1, time_imb, max_min_tid, s1 / s0 AS s1_over_s0 FROM (
        SELECT n_threads, median(mrate) FILTER (WHERE socket = 0) AS s0, median(mrate) FILTER (WHERE socket = 1) AS s1,
               median(time_imbalance) AS time_imb FROM pre WHERE schedule = 'precomputed' GROUP BY 1)
      JOIN (SELECT n_threads, max(mrate) / min(mrate) AS max_min_tid FROM tidp GROUP BY 1) USING (n_threads)""",
    doubles="s0 s1 time_imb max_min_tid s1_over_s0",
    ints="n_threads",
)
def socket_rates(spark, d):
    return te.socket_rates(measured(spark, d), threads(spark, d))


@query(
    "share_correlation",
    oracle=_PRE_SQL + """ SELECT count(*) AS n_tids, corr(a, b) AS r FROM
        (SELECT tid, median(mrate) AS a FROM pre WHERE schedule = 'precomputed' GROUP BY tid)
        JOIN (SELECT tid, median(n_records) AS b FROM pre WHERE schedule = 'dynamic' GROUP BY tid) USING (tid)""",
    doubles="r",
)
def share_correlation(spark, d):
    return te.share_correlation(measured(spark, d), threads(spark, d))


@query(
    "half_thread_ratio",
    oracle=_PRE_SQL + """, h AS (SELECT *, tid >= (max(tid) OVER (PARTITION BY run_id) + 1) / 2.0::DOUBLE AS up FROM pre)
      SELECT n_threads, lower, upper, upper / lower AS ratio FROM (
        SELECT n_threads, median(rate) FILTER (WHERE NOT up) AS lower, median(rate) FILTER (WHERE up) AS upper FROM h GROUP BY 1)""",
    doubles="lower upper ratio",
    ints="n_threads",
)
def half_thread_ratio(spark, d):
    return te.half_thread_ratio(measured(spark, d), threads(spark, d))


@query(
    "granularity_ladder",
    oracle=RUNS_SQL + """, l AS (SELECT csr_variant, tile, median(mrec) AS mrec, median(mrec * time_imbalance) AS mean_thread, median(time_imbalance) AS time_imb
        FROM m WHERE schedule = 'precomputed' GROUP BY 1, 2)
      SELECT *, 100 * (mrec / lag(mrec) OVER w - 1) AS step_pct, 100 * (mean_thread / lag(mean_thread) OVER w - 1) AS mean_pp,
        -100 * (time_imb / lag(time_imb) OVER w - 1) AS straggle_pp FROM l WINDOW w AS (PARTITION BY csr_variant ORDER BY tile)""",
    doubles="mrec mean_thread time_imb step_pct mean_pp straggle_pp",
    ints="tile",
)
def granularity_ladder(spark, d):
    return te.granularity(measured(spark, d))


@query(
    "linfit_r2",
    oracle=RUNS_SQL + """ SELECT platform, count(*) AS n, regr_slope(ipc, l3_per_rec) AS slope, regr_intercept(ipc, l3_per_rec) AS intercept,
        regr_r2(ipc, l3_per_rec) AS r2 FROM m WHERE ipc IS NOT NULL AND l3_per_rec IS NOT NULL GROUP BY platform""",
    doubles="slope intercept r2",
    digits=4,
)
def linfit_r2(spark, d):
    return te.counter_fit(measured(spark, d), "l3_per_rec", "ipc", ["platform"])


@query(
    "paired_sign",
    oracle=_PRE_SQL + """ SELECT tid, shared, per_rank, 100 * (per_rank / shared - 1) AS gain_pct, sign(per_rank / shared - 1) AS sign FROM (
        SELECT tid, median(r.rate) FILTER (WHERE per_rank_csr = 0) AS shared, median(r.rate) FILTER (WHERE per_rank_csr = 1) AS per_rank
        FROM rated r JOIN m USING (run_id) GROUP BY tid)""",
    doubles="shared per_rank gain_pct",
    ints="tid sign",
)
def paired_sign(spark, d):
    return te.paired_sign(measured(spark, d), threads(spark, d))


@query(
    "paired_halves",
    oracle=_PRE_SQL + """, d AS (SELECT tid, 100 * (per_rank / shared - 1) AS g, count(*) OVER () // 2 AS half FROM (
        SELECT tid, median(r.rate) FILTER (WHERE per_rank_csr = 0) AS shared, median(r.rate) FILTER (WHERE per_rank_csr = 1) AS per_rank
        FROM rated r JOIN m USING (run_id) GROUP BY tid) WHERE per_rank IS NOT NULL AND shared IS NOT NULL)
      SELECT *, (low_mean - high_mean) / 2 AS penalty_pct, low_positive + high_negative AS n_predicted,
        (low_mean - high_mean) / 2 BETWEEN 0.79 AND 1.70 AS consistent FROM (
        SELECT max(half) AS half, avg(g) FILTER (WHERE tid < half) AS low_mean, avg(g) FILTER (WHERE tid >= half) AS high_mean,
          count(*) FILTER (WHERE tid < half AND g > 0) AS low_positive, count(*) FILTER (WHERE tid >= half AND g < 0) AS high_negative,
          count(*) AS n_threads FROM d)""",
    doubles="low_mean high_mean penalty_pct",
    ints="half low_positive high_negative n_threads n_predicted",
)
def paired_halves(spark, d):
    return te.paired_halves(te.paired_sign(measured(spark, d), threads(spark, d)))


@query(
    "partition_sweep",
    oracle=RUNS_SQL + """, g AS (SELECT p, partitioner, count(*) AS n, median(work_imbalance) AS measured, median(mrec_ghz) AS mrec_ghz
          FROM m WHERE bitidentical <> 'fail' GROUP BY 1, 2),
      j AS (SELECT g.*, pred_imb FROM g LEFT JOIN predictions x ON x.p = g.p AND x.partitioner = g.partitioner)
      SELECT *, 100 * (measured / pred_imb - 1) AS error_pct, 100 * (mrec_ghz / max(mrec_ghz) OVER w - 1) AS vs_best_pct,
        100 * (mrec_ghz / max(mrec_ghz) FILTER (WHERE partitioner = 'block') OVER w - 1) AS gain_pct,
        100 * (max(pred_imb) FILTER (WHERE partitioner = 'block') OVER w / pred_imb - 1) AS predicted_gain_pct
      FROM j WINDOW w AS (PARTITION BY p)""",
    doubles="measured mrec_ghz pred_imb error_pct vs_best_pct gain_pct predicted_gain_pct",
    ints="p",
)
def partition_sweep(spark, d):
    return te.partition_sweep(measured(spark, d), relation(spark, d, "predictions"))


_INV_SQL = RUNS_SQL + """, inv AS (SELECT job_id, platform, csr_variant, partitioner, schedule, thread_placement, n_nodes, n_ranks, n_threads, p,
    seam_expected, min(contam) AS "min", max(contam) AS "max", count(*) AS n, median(contam) AS "median", median(contam) BETWEEN 1.06 AND 1.16 AS in_band
    FROM m WHERE timed_region = 'kernel' GROUP BY ALL)"""


@query(
    "contamination_inventory",
    oracle=_INV_SQL + " SELECT * FROM inv",
    doubles="min max median",
    ints="n_nodes n_ranks n_threads",
)
def contamination_inventory(spark, d):
    return te.inventory(measured(spark, d))


@query(
    "seam_verdict",
    oracle=_INV_SQL + """ SELECT seam_expected, count(*) AS n_cells, count(*) FILTER (WHERE in_band) AS n_in_band, min("median") AS lo,
        max("median") AS hi, count(*) FILTER (WHERE "median" BETWEEN 0.98 AND 1.02) AS n_near_one, median("median") AS median_of_medians
        FROM inv GROUP BY seam_expected""",
    doubles="lo hi median_of_medians",
)
def seam_verdict(spark, d):
    return te.seam_verdict(measured(spark, d))


@query(
    "clock_ramp",
    oracle=RUNS_SQL + """ SELECT job_id, count(*) AS n, corr(contam, ghz) AS r_clock, corr(contam, repetition) AS r_repetition,
        arg_min(contam, (repetition, run_id)) AS first, arg_max(contam, (repetition, run_id)) AS last, median(contam) AS median_all,
        median(contam) FILTER (WHERE repetition >= 3) AS median_late FROM m GROUP BY job_id""",
    doubles="r_clock r_repetition first last median_all median_late",
)
def clock_ramp(spark, d):
    return te.ramp(measured(spark, d))


@query(
    "crosstab_pivot",
    oracle=oracle_prefix("runs") + """ SELECT paradigm, timed_region, count(*) FILTER (WHERE bitidentical = 'pass') AS pass,
        count(*) FILTER (WHERE bitidentical = 'fail') AS fail, count(*) FILTER (WHERE bitidentical = 'skip') AS skip FROM runs GROUP BY 1, 2""",
)
def crosstab_pivot(spark, d):
    return te.verdict_table(runs(spark, d), ["paradigm", "timed_region"])


@query(
    "identity_by_partitioner",
    oracle=oracle_prefix("runs") + """ SELECT partitioner, count(*) AS n_judged, bool_and(bitidentical = 'pass') AS all_pass
      FROM runs WHERE bitidentical <> 'skip' GROUP BY partitioner""",
)
def identity_by_partitioner(spark, d):
    return te.all_identical(runs(spark, d))


@query(
    "warmup_policy",
    oracle=oracle_prefix("runs") + """ SELECT warmup, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT repetition)), ',') AS repetitions
      FROM runs GROUP BY warmup""",
    ints="warmup",
)
def warmup_policy(spark, d):
    out = te.warmup_policy(runs(spark, d))
    return out.withColumn("repetitions", F.array_join(F.transform("repetitions", lambda x: x.cast("string")), ","))


@query(
    "smt_gain",
    oracle=RUNS_SQL + """ SELECT n_threads, socket0, spread, smt, 100 * (smt / socket0 - 1) AS smt_vs_socket0_pct FROM (
        SELECT n_threads, median(mrec_ghz) FILTER (WHERE thread_placement = 'socket0') AS socket0,
          median(mrec_ghz) FILTER (WHERE thread_placement = 'spread') AS spread,
          median(mrec_ghz) FILTER (WHERE thread_placement = 'smt') AS smt FROM m GROUP BY n_threads)""",
    doubles="socket0 spread smt smt_vs_socket0_pct",
    ints="n_threads",
)
def smt_gain(spark, d):
    return te.smt_gain(measured(spark, d))


@query(
    "hybrid_best",
    oracle=RUNS_SQL + """, g AS (SELECT csr_variant, n_ranks, n_threads, median(mrec_ghz) AS v FROM m GROUP BY 1, 2, 3),
      k AS (SELECT *, row_number() OVER (PARTITION BY csr_variant ORDER BY v DESC, n_ranks, n_threads) AS rk FROM g WHERE v IS NOT NULL)
      SELECT csr_variant, max(n_ranks) FILTER (WHERE rk = 1) AS best_ranks, max(n_threads) FILTER (WHERE rk = 1) AS best_threads,
        100 * (max(v) FILTER (WHERE rk = 1) / max(v) FILTER (WHERE rk = 2) - 1) AS margin_pct,
        100 * (max(v) FILTER (WHERE rk = 1) / min(v) - 1) AS spread_pct FROM k GROUP BY csr_variant""",
    doubles="margin_pct spread_pct",
    ints="best_ranks best_threads",
)
def hybrid_best(spark, d):
    return te.best_and_second(measured(spark, d))


@query(
    "per_rank_gain",
    oracle=RUNS_SQL + """ SELECT csr_variant, off, "on", 100 * ("on" / off - 1) AS gain_pct FROM (SELECT csr_variant,
        median(mrec_ghz) FILTER (WHERE per_rank_csr = 0) AS off, median(mrec_ghz) FILTER (WHERE per_rank_csr = 1) AS "on" FROM m GROUP BY 1)""",
    doubles='off "on" gain_pct',
)
def per_rank_gain(spark, d):
    return te.pooled_effect(measured(spark, d), ["csr_variant"], "per_rank")


_VARYING = ["node", "csr_variant", "partitioner", "schedule", "row_order", "n_threads", "stage_mode", "mempolicy", "k_iterations"]


@query(
    "varying_columns",
    oracle=oracle_prefix("runs") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM runs" for c in _VARYING
    ),
)
def varying_columns(spark, d):
    return te.varying_columns(runs(spark, d), _VARYING)


@query(
    "tile_sweep",
    oracle=oracle_prefix("tile_runs") + """, t AS (SELECT win, tile, median(records_per_s) AS mid,
          quantile_cont(records_per_s, 0.75) - quantile_cont(records_per_s, 0.25) AS within FROM tile_runs GROUP BY 1, 2),
      s AS (SELECT win, count(*) AS n_tiles, (quantile_cont(mid, 0.75) - quantile_cont(mid, 0.25)) / median(within) AS iqr_ratio,
          corr(log2(tile), mid) AS r_log_tile FROM t GROUP BY win)
      SELECT win, n_tiles, iqr_ratio, iqr_ratio < 2 AS flat, r_log_tile FROM s""",
    doubles="iqr_ratio r_log_tile",
)
def tile_sweep(spark, d):
    return te.tile_sweep(relation(spark, d, "tile_runs"))


@query(
    "roofline",
    oracle=RUNS_SQL + """, l AS (SELECT platform, n_threads, median(mrec) AS mrec FROM m GROUP BY 1, 2),
      k AS (SELECT *, max(mrec) OVER (PARTITION BY platform) AS plateau FROM l)
      SELECT platform, max(plateau) AS plateau, min(n_threads) FILTER (WHERE mrec >= 0.95 * plateau) AS knee_threads,
        max(plateau) / 0.158 AS implied_knee FROM k GROUP BY platform""",
    doubles="plateau implied_knee",
    ints="knee_threads",
)
def roofline(spark, d):
    return te.roofline(measured(spark, d), 0.158)


@query(
    "placement_effects",
    oracle=RUNS_SQL + """, c AS (SELECT platform,
        median(mrec_ghz) FILTER (WHERE partitioner = 'block' AND thread_placement = 'socket0' AND n_threads = 2) AS t2,
        median(mrec_ghz) FILTER (WHERE partitioner = 'block' AND thread_placement = 'socket0' AND n_threads = 8) AS t8,
        median(mrec_ghz) FILTER (WHERE partitioner = 'block' AND thread_placement = 'spread' AND schedule = 'precomputed' AND n_threads = 16) AS b16,
        median(mrec_ghz) FILTER (WHERE partitioner = 'cyclic' AND thread_placement = 'spread' AND schedule = 'precomputed' AND n_threads = 16) AS c16,
        median(mrec_ghz) FILTER (WHERE partitioner = 'greedy' AND thread_placement = 'spread' AND schedule = 'precomputed' AND n_threads = 16) AS g16,
        median(mrec_ghz) FILTER (WHERE partitioner = 'block' AND thread_placement = 'spread' AND schedule = 'precomputed' AND n_threads = 12) AS b12,
        median(mrec_ghz) FILTER (WHERE partitioner = 'block' AND thread_placement = 'spread' AND schedule = 'precomputed' AND n_threads = 14) AS b14,
        median(mrec_ghz) FILTER (WHERE thread_placement = 'smt' AND n_threads = 16) AS s16,
        median(mrec_ghz) FILTER (WHERE thread_placement = 'socket0' AND n_threads = 8) AS s8 FROM m GROUP BY platform)
      SELECT platform, 100 * (t8 / 4) / t2 AS socket_efficiency_pct, 100 * (c16 / b16 - 1) AS cyclic_vs_block_pct,
        100 * (g16 / b16 - 1) AS greedy_vs_block_pct, 100 * (b14 / b12 - 1) AS dip_12_14_pct, 100 * (s16 / s8 - 1) AS smt_gain_pct FROM c""",
    doubles="socket_efficiency_pct cyclic_vs_block_pct greedy_vs_block_pct dip_12_14_pct smt_gain_pct",
)
def placement_effects(spark, d):
    return te.effects(measured(spark, d))


@query(
    "dose_response",
    oracle=RUNS_SQL + """, c AS (SELECT p, repetition, median(mrec_ghz) FILTER (WHERE partitioner = 'nzbalanced') AS a,
          median(mrec_ghz) FILTER (WHERE partitioner = 'block') AS b FROM m GROUP BY 1, 2),
      r AS (SELECT p, 100 * (a / b - 1) AS ratio FROM c WHERE a IS NOT NULL AND b IS NOT NULL)
      SELECT p, min(ratio) AS lo, max(ratio) AS hi, count(*) FILTER (WHERE ratio > 0) AS n_pos, count(*) AS n_rep, median(ratio) AS "median" FROM r GROUP BY p""",
    doubles="lo hi median",
    ints="p",
)
def dose_response(spark, d):
    return te.dose_response(measured(spark, d), treated="nzbalanced")


@query(
    "launch_order",
    oracle=oracle_prefix("runs") + """, f AS (SELECT CAST(split_part(run_id, '-', 3) AS BIGINT) AS pid,
          arg_min(csr_variant, run_id) AS csr_variant, arg_min(schedule, run_id) AS schedule FROM runs GROUP BY 1),
      g AS (SELECT dense_rank() OVER (ORDER BY pid) - 1 AS pos, * FROM f)
      SELECT pos, pid, csr_variant, schedule, (csr_variant = CASE WHEN pos % 2 = 0 THEN 'W24' ELSE 'Wfull' END AND schedule = 'dynamic') AS ok FROM g""",
    ints="pid",
)
def launch_order(spark, d):
    frame = runs(spark, d)
    pid = F.split_part(F.col("run_id"), F.lit("-"), F.lit(3))
    plan = spark.range(frame.select(pid.alias("pid")).distinct().count()).select(
        F.col("id").alias("pos"),
        F.when(F.pmod("id", F.lit(2)) == 0, "W24").otherwise("Wfull").alias("csr_variant"),
        F.lit("dynamic").alias("schedule"),
    )
    return te.launch_order(frame, plan)


@query(
    "rolling_median",
    oracle=RUNS_SQL + """, s AS (SELECT p, median(contam) AS c FROM m GROUP BY p)
      SELECT p, c, median(c) OVER (ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rolling FROM s""",
    doubles="c rolling",
    ints="p",
)
def rolling_median(spark, d):
    from talus.operators.quantiles import medians

    return te.rolling_median(medians(measured(spark, d), ["p"], {"c": "contam"}), "p", "c", 5)


@query(
    "transitions",
    oracle=RUNS_SQL + " SELECT transitions, count(*) AS n_runs FROM shape GROUP BY transitions",
    ints="transitions",
)
def transitions(spark, d):
    return te.thread_layout(threads(spark, d)).groupBy("transitions").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "rank_agreement",
    oracle=RUNS_SQL + """, s AS (SELECT partitioner, median(mrec) AS a, median(mrec_ghz) AS b FROM m GROUP BY 1),
      r AS (SELECT *, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rank_a,
                   rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rank_b FROM s)
      SELECT *, rank_a = rank_b AS agree FROM r""",
    doubles="a b rank_a rank_b",
)
def rank_agreement(spark, d):
    from talus.operators.quantiles import medians

    return te.rank_agreement(medians(measured(spark, d), ["partitioner"], {"a": "mrec", "b": "mrec_ghz"}), "a", "b")


@query(
    "interpolated_prediction",
    oracle=RUNS_SQL + """, seen AS (SELECT p::DOUBLE AS p, median(work_imbalance) AS measured FROM m WHERE partitioner = 'block' GROUP BY 1),
      tab AS (SELECT p::DOUBLE AS x, min(pred_imb) AS y FROM predictions WHERE partitioner = 'block' GROUP BY 1),
      pr AS (SELECT p, measured, coalesce(
          (SELECT l.y + (h.y - l.y) * (p - l.x) / nullif(h.x - l.x, 0) FROM tab l, tab h
           WHERE l.x = (SELECT max(x) FROM tab WHERE x <= p) AND h.x = (SELECT min(x) FROM tab WHERE x >= p)),
          (SELECT y FROM tab WHERE x = p)) AS predicted FROM seen)
      SELECT *, 100 * (measured / predicted - 1) AS error_pct FROM pr""",
    doubles="p measured predicted error_pct",
)
def interpolated_prediction(spark, d):
    return te.against_prediction(measured(spark, d), relation(spark, d, "predictions"))


@query(
    "weighted_share",
    oracle=oracle_prefix("threads") + """ SELECT socket, sum(n_records) AS weight, sum(n_records)::DOUBLE / sum(sum(n_records)) OVER () AS share
      FROM threads GROUP BY socket""",
    doubles="share",
    ints="socket weight",
)
def weighted_share(spark, d):
    return te.weighted_share(threads(spark, d), "socket")


@query(
    "rank_reduction",
    oracle=RUNS_SQL + """ SELECT job_id, n_ranks, max(secs) AS max_secs, sum(records) AS records, count(*) AS n_runs FROM (
        SELECT job_id, n_ranks, run_id, max(secs) AS secs, sum(t.n_records) AS records FROM threads t JOIN m USING (run_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    doubles="max_secs",
    ints="n_ranks records",
)
def rank_reduction(spark, d):
    return te.reduce_ranks(measured(spark, d), threads(spark, d))


@query(
    "worker_imbalance_by_order",
    oracle="""WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, count(*) AS n_workers, max(n) / avg(n) AS work_imbalance FROM w GROUP BY l_orderkey""",
    doubles="work_imbalance",
)
def worker_imbalance_by_order(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("n"))
    return per.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_workers"), (F.max("n") / F.avg("n")).alias("work_imbalance")
    )
