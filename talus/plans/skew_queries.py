"""Distribution, partitioners, advisor and bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from talus.operators import advisor as ad
from talus.operators import bootstrap as bs
from talus.operators import distribution as di
from talus.operators import partitioners as pt
from talus.operators import quality
from talus.operators.kernel import unit_work
from talus.operators.prefix import dense_index_by_id
from talus.plans.adapters import table
from talus.plans.cohort_queries import RECORD_COLUMNS, RECORD_SQL, cohort, raw_records
from talus.plans.feature_queries import SPEC_SQL, specification
from talus.plans.registry import query
from talus.operators import records as rec
from talus.session import cut_lineage

PS = [16, 32, 64, 96]
SWEEP = [8, 16, 32, 64, 80, 96]
PAIRS = [(p // 8, 8) for p in SWEEP]


def doc_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"))


def page_sizes(spark, d):
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n"))


def customer_sizes(spark, d):
    """Lines per customer: lines are counted per order before the join."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("m"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    counts = orders.join(lines, "o_orderkey").groupBy("c_custkey").agg(F.sum("m").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["n"])


def user_sizes(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


VECTORS = {"documents": doc_sizes, "pages": page_sizes, "customers": customer_sizes, "users": user_sizes}


def doc_units(spark, d):
    return dense_index_by_id(doc_sizes(spark, d), "doc_id").select("idx", "n")


def doc_load(spark, d):
    return pt.Workload(doc_sizes(spark, d), "doc_id")


UNITS_SQL = "WITH units AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, n_chars AS n FROM documents)"
VECTORS_SQL = """WITH vectors AS (
  SELECT 'documents' AS vector, n_chars AS n FROM documents UNION ALL
  SELECT 'pages', length(html) FROM pages UNION ALL
  SELECT 'customers', coalesce(m, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders
      JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) ON o_custkey = c_custkey UNION ALL
  SELECT 'users', count(*) FROM events GROUP BY user_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vector ORDER BY n) AS r,
             row_number() OVER (PARTITION BY vector ORDER BY n DESC) AS rd,
             count(*) OVER (PARTITION BY vector) AS nn, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY vector) AS np FROM vectors)"""


def all_vectors(spark, d):
    """All unit vectors as one (vector, n) relation."""
    parts = [sizes(spark, d).select(F.lit(name).alias("vector"), "n") for name, sizes in VECTORS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def hill_sql(fraction: float) -> str:
    k = f"greatest(2, floor({fraction}::DOUBLE * np))"
    return (
        f"CASE WHEN max({k}) < max(np) THEN 1.0 / nullif(sum(ln(n)) FILTER (WHERE rd <= {k} AND n > 0) / max({k}) "
        f"- max(ln(n)) FILTER (WHERE rd = {k} + 1 AND n > 0), 0) END"
    )


_DESCRIBE_SQL = VECTORS_SQL + f""" SELECT vector, count(*) AS n_units, sum(n) AS n_records,
  count(*) FILTER (WHERE n = 0) AS n_empty, min(n) AS min_unit, max(n) AS max_unit, avg(n) AS mean_unit,
  stddev_samp(n) AS std_samp, stddev_pop(n) AS std_pop,
  2 * sum(r::DOUBLE * n) / (count(*)::DOUBLE * sum(n)) - (count(*) + 1)::DOUBLE / count(*) AS gini,
  sum(n) FILTER (WHERE rd <= greatest(1, nn // 100))::DOUBLE / sum(n) AS top1pct_share,
  quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95,
  quantile_cont(n, 0.99) AS p99, quantile_cont(n, 0.999) AS p999,
  {hill_sql(0.001)} AS hill_0_001, {hill_sql(0.005)} AS hill_0_005, {hill_sql(0.01)} AS hill_0_01,
  {hill_sql(0.02)} AS hill_0_02, {hill_sql(0.05)} AS hill_0_05, {hill_sql(0.1)} AS hill_0_1,
  stddev_samp(n) / avg(n) AS cv_samp, stddev_pop(n) / avg(n) AS cv_pop,
  quantile_cont(n, 0.99) / quantile_cont(n, 0.5) AS p99_over_median, max(n)::DOUBLE / quantile_cont(n, 0.5) AS max_over_median,
  max(n) / avg(n) AS max_over_mean, sum(n)::DOUBLE / max(n) AS p_atom,
  (2 * sum(r::DOUBLE * n) / (count(*)::DOUBLE * sum(n)) - (count(*) + 1)::DOUBLE / count(*) > 0.4
   AND quantile_cont(n, 0.99) / quantile_cont(n, 0.5) > 10) AS heavy_tailed
  FROM ranked GROUP BY vector"""


@query(
    "skew_describe",
    oracle=_DESCRIBE_SQL,
    doubles="mean_unit std_samp std_pop gini top1pct_share p50 p75 p90 p95 p99 p999 hill_0_001 hill_0_005 hill_0_01 hill_0_02 "
    "hill_0_05 hill_0_1 cv_samp cv_pop p99_over_median max_over_median max_over_mean p_atom",
    ints="n_records min_unit max_unit",
)
def skew_describe(spark, d):
    return di.heavy_tail_gate(di.describe(all_vectors(spark, d), ["vector"]))


@query(
    "gini",
    oracle=UNITS_SQL + """ SELECT 2 * sum(r::DOUBLE * n) / (count(*)::DOUBLE * sum(n)) - (count(*) + 1)::DOUBLE / count(*) AS gini
      FROM (SELECT n, row_number() OVER (ORDER BY n) AS r FROM units)""",
    doubles="gini",
)
def gini(spark, d):
    return di.describe(doc_sizes(spark, d)).select("gini")


@query(
    "hill",
    oracle=VECTORS_SQL + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {f}::DOUBLE AS fraction, max(greatest(2, floor({f}::DOUBLE * np))) AS k, {hill_sql(f)} AS hill "
        "FROM ranked WHERE vector = 'documents'" for f in di.HILL_FRACTIONS
    ) + ")",
    doubles="fraction hill",
    ints="k",
)
def hill(spark, d):
    return di.hill_series(doc_sizes(spark, d))


@query(
    "top1_share",
    oracle=UNITS_SQL + """ SELECT sum(n) FILTER (WHERE rd <= greatest(1, nn // 100))::DOUBLE / sum(n) AS top1pct_share FROM
      (SELECT n, row_number() OVER (ORDER BY n DESC) AS rd, count(*) OVER () AS nn FROM units)""",
    doubles="top1pct_share",
)
def top1_share(spark, d):
    return di.describe(doc_sizes(spark, d)).select("top1pct_share")


@query(
    "ccdf",
    oracle=UNITS_SQL + """ SELECT n AS x, count(*) AS n_units_at,
        1 - (sum(count(*)) OVER (ORDER BY n) - count(*))::DOUBLE / sum(count(*)) OVER () AS ccdf
      FROM units WHERE n > 0 GROUP BY n""",
    doubles="ccdf",
)
def ccdf(spark, d):
    return di.ccdf(doc_sizes(spark, d))


@query(
    "lorenz",
    oracle=UNITS_SQL + """ SELECT n AS x, (sum(count(*)) OVER (ORDER BY n))::DOUBLE / sum(count(*)) OVER () AS unit_share,
        (sum(sum(n)) OVER (ORDER BY n))::DOUBLE / sum(sum(n)) OVER () AS record_share FROM units GROUP BY n""",
    doubles="unit_share record_share",
)
def lorenz(spark, d):
    return di.lorenz(doc_sizes(spark, d))


# ----------------------------------------------------------------- partitioners
_GRID_P = "(VALUES (16), (32), (64), (96)) AS g(p)"


@query(
    "cyclic_loads",
    oracle=UNITS_SQL + f" SELECT p, idx % p AS worker, sum(n) AS load FROM units, {_GRID_P} GROUP BY 1, 2",
    ints="p worker load",
)
def cyclic_loads(spark, d):
    return pt.cyclic_loads(doc_units(spark, d), PS)


@query(
    "block_cyclic_loads",
    oracle=UNITS_SQL + f" SELECT p, (idx // 4) % p AS worker, sum(n) AS load FROM units, {_GRID_P} GROUP BY 1, 2",
    ints="p worker load",
)
def block_cyclic_loads(spark, d):
    return pt.block_cyclic_loads(doc_units(spark, d), PS, 4)


@query(
    "block_loads",
    oracle=UNITS_SQL + f""" SELECT p, ((idx + 1) * p - 1) // (SELECT count(*) FROM units) AS worker, sum(n) AS load
      FROM units, {_GRID_P} GROUP BY 1, 2""",
    ints="p worker load",
)
def block_loads(spark, d):
    load = doc_load(spark, d)
    return pt.loads_by_rule(load.units, PS, lambda i, p: pt.worker_block(i, F.lit(load.n_units), p))


_CUM_SQL = UNITS_SQL + """,
cum AS (SELECT idx + 1 AS j, sum(n) OVER (ORDER BY idx) AS cs FROM units UNION ALL SELECT 0, 0),
tot AS (SELECT max(cs)::BIGINT AS total, max(j) AS n FROM cum)"""
_LINSPACE_SQL = _CUM_SQL + f""",
cuts AS (SELECT p, i, CASE WHEN i = p THEN n ELSE floor(i * (n::DOUBLE / p)) END AS cut
         FROM tot, {_GRID_P}, LATERAL (SELECT unnest(range(p + 1)) AS i))"""


@query(
    "block_linspace_loads",
    oracle=_LINSPACE_SQL + """ SELECT p, i AS worker, b.cs - a.cs AS load FROM (
      SELECT p, i, cut, lead(cut) OVER (PARTITION BY p ORDER BY i) AS nxt FROM cuts) c
      JOIN cum a ON a.j = c.cut JOIN cum b ON b.j = c.nxt""",
    ints="p worker load",
)
def block_linspace_loads(spark, d):
    load = doc_load(spark, d)
    return pt.part_loads(pt.linspace_cuts(load, PS), ["p"])


@query(
    "block_round_loads",
    oracle=_CUM_SQL + f""",
      cuts AS (SELECT p, i, CAST(floor((n * i)::DOUBLE / p + 0.5) AS BIGINT) AS cut FROM tot, {_GRID_P}, LATERAL (SELECT unnest(range(p + 1)) AS i))
      SELECT p, i AS worker, b.cs - a.cs AS load FROM (SELECT p, i, cut, lead(cut) OVER (PARTITION BY p ORDER BY i) AS nxt FROM cuts) c
      JOIN cum a ON a.j = c.cut JOIN cum b ON b.j = c.nxt""",
    ints="p worker load",
)
def block_round_loads(spark, d):
    return pt.part_loads(pt.rounded_cuts(doc_load(spark, d), PS), ["p"])


@query(
    "block_sorted_loads",
    oracle=_LINSPACE_SQL.replace("ORDER BY doc_id", "ORDER BY n_chars DESC, doc_id") + """
      SELECT p, i AS worker, b.cs - a.cs AS load FROM (
      SELECT p, i, cut, lead(cut) OVER (PARTITION BY p ORDER BY i) AS nxt FROM cuts) c
      JOIN cum a ON a.j = c.cut JOIN cum b ON b.j = c.nxt""",
    ints="p worker load",
)
def block_sorted_loads(spark, d):
    return pt.block_sorted_loads(doc_load(spark, d), PS)


def nearest_sql(grid: str, room: bool) -> str:
    """One-stage nearest-boundary cuts: (p, i, cut, cs)."""
    j = "least(s.j, n - (p - i))" if room else "s.j"
    run = (
        "least(n, greatest(0, max(%s - i) OVER w) + i)" % j if room else "max(s.j) OVER w"
    )
    return f""",
targets AS (SELECT p, i, total::DOUBLE * i / p AS t FROM tot, {grid}, LATERAL (SELECT unnest(range(1, p)) AS i)),
above AS (SELECT p, i, t, min(j) AS hi FROM targets JOIN cum ON cs >= t GROUP BY 1, 2, 3),
snapped AS (
  SELECT p, i, CASE WHEN hi > 0 AND abs(l.cs - t) <= abs(h.cs - t) THEN hi - 1 ELSE hi END AS j
  FROM above JOIN cum h ON h.j = hi LEFT JOIN cum l ON l.j = hi - 1),
cuts AS (
  SELECT p, i, CAST({run} AS BIGINT) AS cut FROM snapped s, tot
  WINDOW w AS (PARTITION BY p ORDER BY i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT p, 0, 0 FROM {grid} UNION ALL SELECT p, p, n FROM {grid}, tot)"""


@query(
    "nz_cuts",
    oracle=_CUM_SQL + nearest_sql(_GRID_P, True) + " SELECT p, i, cut, cs FROM cuts JOIN cum ON cum.j = cut",
    ints="p i cut cs",
)
def nz_cuts(spark, d):
    return pt.balanced_cuts(doc_load(spark, d), PS)


@query(
    "nz_monotone_cuts",
    oracle=_CUM_SQL + nearest_sql(_GRID_P, False) + " SELECT p, i, cut, cs FROM cuts JOIN cum ON cum.j = cut",
    ints="p i cut cs",
)
def nz_monotone_cuts(spark, d):
    return pt.balanced_cuts(doc_load(spark, d), PS, "monotone")


@query(
    "nz_floor_cuts",
    oracle=_CUM_SQL + f""" SELECT p, i, cut, cs FROM (
        SELECT p, i, (SELECT max(j) FROM cum WHERE cs < total::DOUBLE * i / p) AS cut
        FROM tot, {_GRID_P}, LATERAL (SELECT unnest(range(1, p)) AS i)
        UNION ALL SELECT p, 0, 0 FROM {_GRID_P} UNION ALL SELECT p, p, n FROM {_GRID_P}, tot) JOIN cum ON cum.j = cut""",
    ints="p i cut cs",
)
def nz_floor_cuts(spark, d):
    return pt.balanced_cuts(doc_load(spark, d), PS, "floor")


_TWO_STAGE = """,
cumw AS (SELECT w, idx + 1 AS j, CAST(sum(n) OVER (PARTITION BY w ORDER BY idx) AS BIGINT) AS cs FROM unitsw UNION ALL SELECT DISTINCT w, 0, 0 FROM unitsw),
tot AS (SELECT w, max(cs) AS total, max(j) AS n FROM cumw GROUP BY w),
firsts AS (SELECT w, cs::DOUBLE AS x, min(j) AS j FROM cumw GROUP BY 1, 2),
pairs AS (SELECT w, r::BIGINT AS r, t::BIGINT AS t FROM ({pairs})),
tg AS (SELECT w, r, i, total::DOUBLE * i / r AS x FROM (SELECT DISTINCT w, r FROM pairs) JOIN tot USING (w), LATERAL (SELECT unnest(range(1, r)) AS i)),
ab AS (SELECT tg.w, r, i, tg.x, j AS hi FROM tg ASOF JOIN firsts f ON tg.w = f.w AND tg.x <= f.x),
sn AS (SELECT ab.w, r, i, CASE WHEN hi > 0 AND abs(l.cs - x) <= abs(h.cs - x) THEN hi - 1 ELSE hi END AS j
       FROM ab JOIN cumw h ON h.w = ab.w AND h.j = hi LEFT JOIN cumw l ON l.w = ab.w AND l.j = hi - 1),
rc AS (SELECT w, r, i, least(n, greatest(0, max(least(sn.j, n - (r - i)) - i) OVER q) + i) AS cut FROM sn JOIN tot USING (w)
       WINDOW q AS (PARTITION BY w, r ORDER BY i ROWS UNBOUNDED PRECEDING)
       UNION ALL SELECT DISTINCT w, r, 0, 0 FROM pairs UNION ALL SELECT DISTINCT w, r, r, n FROM pairs JOIN tot USING (w)),
seg AS (SELECT s.w, r, t, k, lo, hi, a.cs AS base, b.cs - a.cs AS seg_total FROM (
          SELECT w, r, i AS k, cut AS lo, lead(cut) OVER (PARTITION BY w, r ORDER BY i) AS hi FROM rc) s
        JOIN pairs USING (w, r) JOIN cumw a ON a.w = s.w AND a.j = lo JOIN cumw b ON b.w = s.w AND b.j = s.hi),
tg2 AS (SELECT w, r, t, k, lo, hi, i, base + (seg_total * i)::DOUBLE / t AS x FROM seg, LATERAL (SELECT unnest(range(1, t)) AS i)),
ab2 AS (SELECT tg2.w, r, t, k, lo, hi AS top, i, tg2.x, greatest(f.j, lo) AS u FROM tg2 ASOF JOIN firsts f ON tg2.w = f.w AND tg2.x <= f.x),
sn2 AS (SELECT ab2.w, r, t, k, lo, top, i, top - lo AS m,
          CASE WHEN u > lo AND abs(l.cs - x) <= abs(h.cs - x) THEN u - 1 ELSE u END - lo AS j
        FROM ab2 JOIN cumw h ON h.w = ab2.w AND h.j = u LEFT JOIN cumw l ON l.w = ab2.w AND l.j = u - 1),
tc AS (SELECT w, r, t, k, i, lo + CASE WHEN m <= t THEN least(i, m)
          ELSE least(m, greatest(0, max(greatest(0, least(j, m - (t - i))) - i) OVER q) + i) END AS cut FROM sn2
       WINDOW q AS (PARTITION BY w, r, t, k ORDER BY i ROWS UNBOUNDED PRECEDING)
       UNION ALL SELECT w, r, t, k, 0, lo FROM seg UNION ALL SELECT w, r, t, k, t, hi FROM seg),
nz AS (SELECT w, r, t, k, i, lead(cs) OVER (PARTITION BY w, r, t, k ORDER BY i) - cs AS load FROM tc JOIN cumw USING (w) WHERE j = cut),
bl AS (SELECT w, r, t, q.i AS i, CASE WHEN q.i = r * t THEN n ELSE
          ((q.i // t) * n) // r + ((q.i % t) * (((q.i // t + 1) * n) // r - ((q.i // t) * n) // r)) // t END AS cut
       FROM pairs JOIN tot USING (w), LATERAL (SELECT unnest(range(r * t + 1)) AS i) q),
blk AS (SELECT w, r, t, lead(cs) OVER (PARTITION BY w, r, t ORDER BY bl.i) - cs AS load FROM bl JOIN cumw USING (w) WHERE j = cut),
imb AS (SELECT w, r, t, r * t AS p, ib / (total::DOUBLE / (r * t)) AS imb_block, iz / (total::DOUBLE / (r * t)) AS imb_balanced
        FROM tot JOIN (SELECT w, r, t, max(load) AS ib FROM blk GROUP BY 1, 2, 3) USING (w)
        JOIN (SELECT w, r, t, max(load) AS iz FROM nz GROUP BY 1, 2, 3) USING (w, r, t))"""
_ONE = UNITS_SQL + ", unitsw AS (SELECT 'documents' AS w, * FROM units)"


def two_stage_sql(pairs: str, units: str = _ONE) -> str:
    """Cuts and loads of both rules; ``pairs`` selects (w, r, t), with tot (w, total, n) at hand."""
    return units + _TWO_STAGE.replace("{pairs}", pairs)


def _pairs_sql(pairs) -> str:
    return "SELECT w, r, t FROM tot, (VALUES " + ", ".join(f"({r}, {t})" for r, t in pairs) + ") AS v(r, t)"


# The search grid and the whole curve, by their own rules.
_SEARCH_SQL = "SELECT w, r, 8 AS t FROM tot, (SELECT unnest(range(1, 1025)) AS r) WHERE r * 8 <= n // 2"
_WHOLE_SQL = """SELECT w, p // t AS r, t FROM tot, (SELECT unnest(range(2, 4097)) AS p UNION ALL SELECT unnest([8192, 16384, 32768])),
  (SELECT unnest(range(1, 17)) AS t) WHERE p % t = 0 AND p // t <= n AND t <= n"""
_TWO_STAGE_SQL = two_stage_sql(_pairs_sql(PAIRS))
_CURVE_COLUMNS = """ SELECT p, r AS n_ranks, t AS n_threads, imb_block, imb_balanced, 100 * (1 - 1 / imb_block) AS loss_block_pct,
  100 * (imb_block / imb_balanced - 1) AS ceiling_pct, p <= 96 AND t <= 16 AS measurable FROM imb"""


@query(
    "nz_loads_two_stage",
    oracle=_TWO_STAGE_SQL + " SELECT r, t, k AS rank, i AS worker, load FROM nz WHERE load IS NOT NULL",
    ints="r t rank worker load",
)
def nz_loads_two_stage(spark, d):
    load = doc_load(spark, d)
    return pt.part_loads(pt.balanced_cuts_two_stage(load, PAIRS), ["r", "t", "rank"])


@query(
    "ceiling_sweep",
    oracle=_TWO_STAGE_SQL + " SELECT r, t, p, imb_block, imb_balanced, imb_block / imb_balanced - 1 AS ceiling FROM imb",
    doubles="imb_block imb_balanced ceiling",
    ints="r t p",
)
def ceiling_sweep(spark, d):
    return ad.ceilings(doc_load(spark, d), PAIRS)


def _advice_sql(units: str, ps: list[int]) -> str:
    """Advice for every workload: p* from the search grid, ceilings of the requests from a second set of pairs."""
    named = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in ad.REGIME_NAMES.items())
    actions = " ".join(f"WHEN '{code}' THEN '{' | '.join(ad.ACTIONS[code])}'" for code in ad.ACTIONS)
    asked = ", ".join(f"({p}, {p // 8}, 8)" for p in ps)
    return two_stage_sql(f"{_SEARCH_SQL} UNION SELECT w, r, t FROM tot, (VALUES {asked}) AS v(p, r, t) WHERE p <= n // 2", units) + f""",
      known AS (SELECT w, s, a FROM (SELECT w, sum(n)::DOUBLE / max(n) AS a FROM unitsw GROUP BY w)
                LEFT JOIN (SELECT w, min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.084 AND p <= 8192) AS s FROM imb GROUP BY w) USING (w)),
      r1 AS (SELECT k.w, v.p, s AS p_star, CASE WHEN v.p < s THEN 'I' WHEN v.p < a THEN 'II' ELSE 'III' END AS regime,
               imb_block / imb_balanced - 1 AS ceiling, v.p / a AS p_over_p_atom
             FROM known k CROSS JOIN (VALUES {asked}) AS v(p, r, t) LEFT JOIN imb ON imb.w = k.w AND imb.r = v.r AND imb.t = v.t)
      SELECT w, p, p_star, regime, CASE regime {named} END AS regime_name, CASE regime {actions} END AS actions, ceiling,
             ceiling / 0.084 AS ceiling_vs_rung, coalesce(ceiling > 0.0239, false) AS resolvable, p_over_p_atom FROM r1"""


@query(
    "regime_advice",
    oracle=f"SELECT * EXCLUDE (w) FROM ({_advice_sql(_ONE, SWEEP)})",
    doubles="ceiling ceiling_vs_rung p_over_p_atom",
    ints="p p_star",
)
def regime_advice(spark, d):
    return ad.advise(doc_load(spark, d), SWEEP).drop("advice").withColumn("actions", F.array_join("actions", " | "))


BATCH = {"documents": ("documents", "doc_id"), "users": ("users", "user_id"), "customers": ("customers", "c_custkey")}
_BATCH_UNITS = """WITH sizes AS (
  SELECT 'documents' AS w, doc_id AS key, n_chars AS n FROM documents UNION ALL
  SELECT 'users', user_id, count(*) FROM events GROUP BY user_id UNION ALL
  SELECT 'customers', c_custkey, coalesce(m, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) ON o_custkey = c_custkey),
unitsw AS (SELECT w, row_number() OVER (PARTITION BY w ORDER BY key) - 1 AS idx, n FROM sizes)"""


def batch(spark, d):
    return pt.Batch({w: (VECTORS[vector](spark, d), key) for w, (vector, key) in BATCH.items()})


@query(
    "advice_batch",
    oracle=_advice_sql(_BATCH_UNITS, SWEEP),
    doubles="ceiling ceiling_vs_rung p_over_p_atom",
    ints="p p_star",
)
def advice_batch(spark, d):
    """Advice for documents, users and customers from one plan."""
    return ad.advise(batch(spark, d), SWEEP).drop("advice").withColumn("actions", F.array_join("actions", " | "))


@query(
    "p_star",
    oracle=two_stage_sql(_SEARCH_SQL) + """
      SELECT (SELECT n FROM tot) AS n_units, min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.084) AS p_star FROM imb""",
    ints="n_units p_star",
)
def p_star(spark, d):
    return ad.p_stars(doc_load(spark, d)).select("n_units", "p_star")


@query(
    "p_star_batch",
    oracle=two_stage_sql(_SEARCH_SQL, _BATCH_UNITS) + """ SELECT w, n AS n_units, total, largest, p_star FROM tot
      JOIN (SELECT w, max(n) AS largest FROM unitsw GROUP BY w) USING (w)
      LEFT JOIN (SELECT w, min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.084) AS p_star FROM imb GROUP BY w) USING (w)""",
    ints="n_units total largest p_star",
)
def p_star_batch(spark, d):
    return ad.p_stars(batch(spark, d))


_GREEDY_SQL = _CUM_SQL + f""",
ordered AS (SELECT n, row_number() OVER (ORDER BY n DESC, idx) AS r FROM units),
dealt AS (
  WITH RECURSIVE g(p, step, loads) AS (
    SELECT p, 0::BIGINT, list_transform(range(p), lambda x: 0::BIGINT) FROM {_GRID_P}
    UNION ALL
    SELECT p, step + 1, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + n ELSE v END)
    FROM g JOIN ordered ON r = step + 1)
  SELECT p, loads FROM g WHERE step = (SELECT count(*) FROM units)),
greedy AS (SELECT p, unnest(range(p)) AS worker, unnest(loads) AS load FROM dealt)"""


@query(
    "imbalance_table",
    oracle=_GREEDY_SQL + f""",
lin AS (SELECT p, i, CASE WHEN i = p THEN n ELSE floor(i * (n::DOUBLE / p)) END AS cut
        FROM tot, {_GRID_P}, LATERAL (SELECT unnest(range(p + 1)) AS i)),
flo AS (SELECT p, i, (SELECT max(j) FROM cum WHERE cs < total::DOUBLE * i / p) AS cut
        FROM tot, {_GRID_P}, LATERAL (SELECT unnest(range(1, p)) AS i)
        UNION ALL SELECT p, 0, 0 FROM {_GRID_P} UNION ALL SELECT p, p, n FROM {_GRID_P}, tot),
down AS (SELECT row_number() OVER (ORDER BY n DESC) AS j, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS cs FROM units
         UNION ALL SELECT 0, 0),
loads AS (
  SELECT 'block' AS strategy, p, lead(cs) OVER (PARTITION BY p ORDER BY i) - cs AS load FROM lin JOIN cum ON cum.j = cut UNION ALL
  SELECT 'nzbalanced', p, lead(cs) OVER (PARTITION BY p ORDER BY i) - cs FROM flo JOIN cum ON cum.j = cut UNION ALL
  SELECT 'block_sorted_desc', p, lead(cs) OVER (PARTITION BY p ORDER BY i) - cs FROM lin JOIN down ON down.j = cut UNION ALL
  SELECT 'cyclic', p, sum(n) FROM units, {_GRID_P} GROUP BY p, idx % p UNION ALL
  SELECT 'greedy', p, load FROM greedy),
worst AS (SELECT strategy, p, max(load) AS max_load FROM loads GROUP BY 1, 2),
one AS (SELECT total, (SELECT max(n) FROM units) AS largest FROM tot)
SELECT strategy, p, max_load, total::DOUBLE / max_load AS speedup, total::DOUBLE / p / max_load AS efficiency,
       total / greatest(total::DOUBLE / p, largest) AS bound_speedup, largest > total::DOUBLE / p AS granularity_limited FROM worst, one""",
    doubles="speedup efficiency bound_speedup",
    ints="p max_load",
)
def imbalance_table(spark, d):
    load = doc_load(spark, d)
    rules = {
        "block": pt.part_loads(pt.linspace_cuts(load, PS), ["p"]),
        "nzbalanced": pt.part_loads(pt.balanced_cuts(load, PS, "floor"), ["p"]),
        "cyclic": pt.cyclic_loads(load.units, PS),
        "greedy": pt.greedy_loads(load.units, PS),
        "block_sorted_desc": pt.block_sorted_loads(load, PS),
    }
    loads = reduce(
        lambda a, b: a.unionByName(b), [df.select("p", "load").withColumn("strategy", F.lit(s)) for s, df in rules.items()]
    )
    mean = F.lit(float(load.total)) / F.col("p")
    return loads.groupBy("strategy", "p").agg(F.max("load").alias("max_load")).select(
        "strategy",
        "p",
        "max_load",
        (F.lit(float(load.total)) / F.col("max_load")).alias("speedup"),
        (mean / F.col("max_load")).alias("efficiency"),
        (F.lit(float(load.total)) / F.greatest(mean, F.lit(float(load.largest)))).alias("bound_speedup"),
        (F.lit(load.largest) > mean).alias("granularity_limited"),
    )


@query("greedy_loads", oracle=_GREEDY_SQL + " SELECT p, worker, load FROM greedy", ints="p worker load")
def greedy_loads(spark, d):
    return pt.greedy_loads(doc_units(spark, d), PS)


_OPT_P = (2, 8, 16, 24, 32, 48, 64, 80)
# Smallest largest load by dynamic programming over the number of parts, then
# the greedy walk at that load.
_OPT_SQL = _CUM_SQL + f""",
opt AS (
  WITH RECURSIVE dp(k, j, best) AS (
    SELECT 1, j, cs FROM cum
    UNION ALL
    SELECT dp.k + 1, b.j, min(greatest(dp.best, b.cs - a.cs))
    FROM dp JOIN cum a ON a.j = dp.j JOIN cum b ON b.j >= a.j WHERE dp.k < {max(_OPT_P)} GROUP BY dp.k + 1, b.j)
  SELECT k AS p, best AS cap FROM dp, tot WHERE j = tot.n AND k IN {_OPT_P}),
walk AS (
  WITH RECURSIVE w(p, i, cut, cs, cap) AS (
    SELECT p, 0, 0, 0::HUGEINT, cap FROM opt
    UNION ALL
    SELECT w.p, w.i + 1, max(c.j), max(c.cs), w.cap FROM w JOIN cum c ON c.cs <= w.cs + w.cap WHERE w.i < w.p GROUP BY w.p, w.i, w.cap)
  SELECT * FROM w)"""


@query("contig_opt_cuts", oracle=_OPT_SQL + " SELECT p, i, cut, cs, cap FROM walk", ints="p i cut cs cap")
def contig_opt_cuts(spark, d):
    return pt.contiguous_optimal(doc_load(spark, d), list(_OPT_P))


@query(
    "imbalance_curve",
    oracle=two_stage_sql(_WHOLE_SQL) + _CURVE_COLUMNS,
    doubles="imb_block imb_balanced loss_block_pct ceiling_pct",
    ints="p n_ranks n_threads",
)
def imbalance_curve(spark, d):
    """The whole curve: p = 2..4096 and the far field, in every factorisation."""
    return ad.curve(doc_load(spark, d), ad.whole_curve)


@query(
    "curve_crossings",
    oracle=two_stage_sql(f"SELECT * FROM ({_WHOLE_SQL}) WHERE t = 8") + """ SELECT min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.0239) AS noise,
        min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.084) AS rung,
        min(p) FILTER (WHERE imb_block / imb_balanced - 1 >= 0.32) AS span FROM imb WHERE t = 8""",
    ints="noise rung span",
)
def curve_crossings(spark, d):
    points = ad.curve(doc_load(spark, d), lambda span: [x for x in ad.whole_curve(span) if x[1] == ad.THREADS_PER_RANK])
    return ad.crossings(points, {"noise": ad.NOISE_FLOOR, "rung": ad.PLACEMENT_RUNG, "span": ad.PLACEMENT_SPAN})


@query(
    "factorisation_spread",
    oracle=two_stage_sql(_pairs_sql(ad.factorisations([16, 32, 64, 96]))) + """ SELECT p, count(*) AS n_ways, min(imb_block) AS lo,
        max(imb_block) AS hi, 100 * (max(imb_block) / min(imb_block) - 1) AS spread_pct FROM imb GROUP BY p""",
    doubles="lo hi spread_pct",
    ints="p",
)
def factorisation_spread(spark, d):
    return ad.factorisation_spread(ad.curve(doc_load(spark, d), ad.factorisations([16, 32, 64, 96])))


@query(
    "floor_audit",
    oracle=_TWO_STAGE_SQL + """ SELECT count(*) AS n_rows, count(*) FILTER (WHERE slack < -1e-12) AS n_violations, min(slack) AS min_slack
      FROM (SELECT least(imb_block, imb_balanced) - p * (SELECT max(n) FROM units)::DOUBLE / total AS slack FROM imb, tot)""",
    doubles="min_slack",
)
def floor_audit(spark, d):
    load = doc_load(spark, d)
    return ad.floor_audit(ad.curve(load, PAIRS), load)


_REGISTER_SQL = """SELECT count(*)::DOUBLE AS n_units, sum(length(text))::DOUBLE AS n_records, max(length(text))::DOUBLE AS largest,
  sum(length(text))::DOUBLE / max(length(text)) AS p_atom FROM documents"""


@query(
    "atomic_register",
    oracle=UNITS_SQL + f""" SELECT name AS quantity, measured, registered, coalesce(abs(measured - registered) <= 1e-9 * greatest(1, abs(registered)), false) AS ok
      FROM (UNPIVOT (SELECT count(*)::DOUBLE AS n_units, sum(n)::DOUBLE AS n_records, max(n)::DOUBLE AS largest, sum(n)::DOUBLE / max(n) AS p_atom FROM units)
            ON n_units, n_records, largest, p_atom INTO NAME name VALUE measured)
      LEFT JOIN (UNPIVOT ({_REGISTER_SQL}) ON n_units, n_records, largest, p_atom INTO NAME name VALUE registered) USING (name)""",
    doubles="measured registered",
)
def atomic_register(spark, d):
    """Stated character counts against the lengths of the texts themselves."""
    size = F.length("text").cast("long")
    whole = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_units"), F.sum(size).alias("n_records"), F.max(size).alias("largest"))
    names = ["n_units", "n_records", "largest", "p_atom"]
    whole = whole.withColumn("p_atom", F.col("n_records") / F.col("largest")).select(*[F.col(n).cast("double") for n in names])
    return ad.atomic_register(doc_load(spark, d), whole.unpivot([], names, "quantity", "registered"))


@query(
    "atomic_floors",
    oracle=_BATCH_UNITS + """ SELECT w, p, p * max(n)::DOUBLE / sum(n) AS floor FROM unitsw, (VALUES (8192), (16384), (32768)) AS g(p) GROUP BY w, p""",
    doubles="floor",
    ints="p",
)
def atomic_floors(spark, d):
    return ad.atomic_floors(batch(spark, d))


@query(
    "window_regimes",
    oracle=RECORD_SQL + """,
      per AS (SELECT c.row_index, count(t) FILTER (WHERE t < 24) AS W24, count(t) AS Wfull FROM cohort c
              LEFT JOIN records r ON r.row_index = c.row_index GROUP BY 1)
      SELECT 'W24' AS variant, count(*) AS n_units, sum(W24) AS n_records, max(W24) AS max_unit, sum(W24)::DOUBLE / max(W24) AS p_atom,
             stddev_pop(W24) / avg(W24) AS cv_pop FROM per
      UNION ALL SELECT 'Wfull', count(*), sum(Wfull), max(Wfull), sum(Wfull)::DOUBLE / max(Wfull), stddev_pop(Wfull) / avg(Wfull) FROM per""",
    doubles="p_atom cv_pop",
    ints="n_records",
)
def window_regimes(spark, d):
    base = cohort(spark, d, *RECORD_COLUMNS)
    wide = cut_lineage(rec.unit_counts(base, raw_records(spark, d, base)))
    long = wide.unpivot(["idx"], ["W24", "Wfull"], "variant", "n")
    return di.describe(long, ["variant"]).select("variant", "n_units", "n_records", "max_unit", "p_atom", "cv_pop")


_WORK_SQL = SPEC_SQL + """, w AS (SELECT c.row_index AS idx, count(r.t) AS n, count(l.dense_id) AS k FROM cohort c
      LEFT JOIN records r ON r.row_index = c.row_index LEFT JOIN lookup l ON l.dense_id = r.dense_id AND l.slot >= 0 GROUP BY 1)"""


def work_units(spark, d):
    s = specification(spark, d)
    units = s.base.select(F.col("row_index").alias("idx"))
    return cut_lineage(unit_work(units, s.records, s.lookup()).select("idx", "n", "k"))


@query(
    "work_profile",
    oracle=_WORK_SQL + """ SELECT rho::DOUBLE AS rho, stddev_pop(n) / avg(n) AS cv_records, stddev_pop(k) / avg(k) AS cv_whitelisted,
        stddev_pop(n + rho::DOUBLE * k) / avg(n + rho::DOUBLE * k) AS cv_work, sum(k)::DOUBLE / sum(n) AS hit_rate,
        avg(k::DOUBLE / nullif(n, 0)) AS mean_h, stddev_pop(k::DOUBLE / nullif(n, 0)) AS sd_h, corr(n, k) AS corr_n_k,
        corr(n::DOUBLE, k::DOUBLE / nullif(n, 0)) AS corr_n_h
      FROM w, (VALUES (3.0), (4.0), (5.31), (6.5), (8.0)) AS g(rho) GROUP BY rho""",
    doubles="rho cv_records cv_whitelisted cv_work hit_rate mean_h sd_h corr_n_k corr_n_h",
)
def work_profile(spark, d):
    return bs.work_profile(work_units(spark, d), [3.0, 4.0, 5.31, 6.5, 8.0])


@query(
    "work_balanced_cuts",
    oracle=_WORK_SQL + """, units AS (SELECT idx, 100 * n + 531 * k AS n FROM w),
      cum AS (SELECT idx + 1 AS j, sum(n) OVER (ORDER BY idx) AS cs FROM units UNION ALL SELECT 0, 0),
      tot AS (SELECT max(cs)::BIGINT AS total, max(j) AS n FROM cum)"""
    + nearest_sql(_GRID_P, False) + " SELECT p, i, cut, cs FROM cuts JOIN cum ON cum.j = cut",
    ints="p i cut cs",
)
def work_balanced_cuts(spark, d):
    load = pt.Workload(pt.scaled_work(work_units(spark, d)))
    return pt.balanced_cuts(load, PS, "monotone")


# -------------------------------------------------------------------- bootstrap
N_BOOT = 1000

_BOOT_TAIL = f"""
perm AS (SELECT b, n, c, row_number() OVER w - 1 AS pos, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cs,
                count(*) OVER (PARTITION BY b) AS nu, sum(n) OVER (PARTITION BY b) AS total, sum(c) OVER (PARTITION BY b) AS whole
         FROM costs, (SELECT unnest(range({N_BOOT + 1})) AS b)
         WINDOW w AS (PARTITION BY b ORDER BY CASE WHEN b = 0 THEN lpad(idx::VARCHAR, 16, '0')
                      ELSE sha256(concat('20260728|', b, '|', idx)) END)),
dealt AS (
  SELECT b, p, 'block' AS strategy, ((pos + 1) * p - 1) // nu AS worker, c, whole FROM perm, (VALUES (8), (16), (96)) AS g(p) UNION ALL
  SELECT b, p, 'cyclic', pos % p, c, whole FROM perm, (VALUES (8), (16), (96)) AS g(p) UNION ALL
  SELECT b, p, 'nzbalanced', least(p - 1, floor((cs - n / 2.0::DOUBLE) * p / total)), c, whole FROM perm, (VALUES (8), (16), (96)) AS g(p)),
eff AS (SELECT b, p, strategy, max(whole)::DOUBLE / max(p) / max(load) AS efficiency FROM (
          SELECT b, p, strategy, worker, sum(c) AS load, max(whole) AS whole FROM dealt GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
_BOOT_SQL = UNITS_SQL + ", costs AS (SELECT idx, n, n AS c FROM units)," + _BOOT_TAIL
_BOOT_SUMMARY = """ SELECT p, strategy, quantile_cont(e.efficiency, 0.025) AS p2_5, quantile_cont(e.efficiency, 0.975) AS p97_5,
        count(*) AS n_boot, avg(e.efficiency) AS boot_mean, stddev_samp(e.efficiency) AS boot_sd, max(c.efficiency) AS canonical,
        100 * avg((e.efficiency <= c.efficiency)::INT) AS percentile,
        100 * avg((e.efficiency <= c.efficiency)::INT) NOT BETWEEN 5 AND 95 AS flagged
      FROM eff e JOIN (SELECT p, strategy, efficiency FROM eff WHERE b = 0) c USING (p, strategy) WHERE b > 0 GROUP BY 1, 2"""


@query(
    "permutation_efficiencies",
    oracle=_BOOT_SQL + " SELECT * FROM eff",
    doubles="efficiency",
    ints="p",
)
def permutation_efficiencies(spark, d):
    return bs.efficiencies(doc_units(spark, d), [8, 16, 96], N_BOOT)


@query(
    "permutation_bootstrap",
    oracle=_BOOT_SQL + _BOOT_SUMMARY,
    doubles="p2_5 p97_5 boot_mean boot_sd canonical percentile",
    ints="p",
)
def permutation_bootstrap(spark, d):
    return bs.summarise_bootstrap(cut_lineage(bs.efficiencies(doc_units(spark, d), [8, 16, 96], N_BOOT)))


@query(
    "permutation_bootstrap_work",
    oracle=_WORK_SQL + ", costs AS (SELECT idx, n, 100 * n + 531 * k AS c FROM w)," + _BOOT_TAIL + _BOOT_SUMMARY,
    doubles="p2_5 p97_5 boot_mean boot_sd canonical percentile",
    ints="p",
)
def permutation_bootstrap_work(spark, d):
    """Cut by records, loads in modelled work (100 n + 531 k)."""
    units = work_units(spark, d)
    costs = units.select("idx", "n", (100 * F.col("n") + 531 * F.col("k")).alias("work"))
    return bs.summarise_bootstrap(cut_lineage(bs.efficiencies(costs, [8, 16, 96], N_BOOT, cost="work")))


@query(
    "forecast_asymptotic",
    oracle=UNITS_SQL + """ SELECT p, nu::DOUBLE / p AS m, cv, 1 / (1 + cv / sqrt(nu::DOUBLE / p) * sqrt(2 * ln(p))) AS asymptotic
      FROM (SELECT count(*) AS nu, stddev_pop(n) / avg(n) AS cv FROM units), (VALUES (8), (16), (96)) AS g(p)""",
    doubles="m cv asymptotic",
    ints="p",
)
def forecast_asymptotic(spark, d):
    return bs.forecasts(spark, doc_units(spark, d), [8, 16, 96]).drop("finite_p")


# Normal distribution function by summing the density on a fine grid.
_FINITE_SQL = UNITS_SQL + """,
grid AS (SELECT x, exp(0 - x * x / 2) / sqrt(2 * pi()) AS d FROM (SELECT (i - 10000) * 0.0009::DOUBLE AS x FROM range(20001) r(i))),
phi AS (SELECT x, least(1.0::DOUBLE, sum((d + coalesce(pd, d)) / 2 * 0.0009::DOUBLE) OVER (ORDER BY x)) AS f
        FROM (SELECT x, d, lag(d) OVER (ORDER BY x) AS pd FROM grid)),
emax AS (SELECT p, sum(CASE WHEN x > 0 THEN 1 - f ** p WHEN x < 0 THEN -(f ** p) ELSE 0.5 - f ** p END) * 0.0009::DOUBLE AS e
         FROM phi, (VALUES (8), (16), (96)) AS g(p) GROUP BY p),
st AS (SELECT count(*) AS nu, stddev_pop(n) / avg(n) AS cv FROM units)"""


@query(
    "forecast_finite",
    oracle=_FINITE_SQL + """ SELECT p, nu::DOUBLE / p AS m, cv, 1 / (1 + cv / sqrt(nu::DOUBLE / p) * sqrt(2 * ln(p))) AS asymptotic,
        1 / (1 + cv / sqrt(nu::DOUBLE / p) * e) AS finite_p FROM emax, st""",
    doubles="m cv asymptotic finite_p",
    ints="p",
    digits=4,
)
def forecast_finite(spark, d):
    return bs.forecasts(spark, doc_units(spark, d), [8, 16, 96])




@query(
    "bootstrap_cross_check",
    oracle=_BOOT_SQL + """ SELECT count(*) AS n_pairs, 0.0 AS max_gap, 0.0 AS rms_gap, 0 AS n_outside FROM eff WHERE b = 0""",
    doubles="max_gap rms_gap",
    ints="n_outside",
)
def bootstrap_cross_check(spark, d):
    """Efficiency of the given order by two independent routes."""
    ps = [8, 16, 96]
    load = doc_load(spark, d)
    routes = {
        "block": pt.loads_by_rule(load.units, ps, lambda i, p: pt.worker_block(i, F.lit(load.n_units), p)),
        "cyclic": pt.cyclic_loads(load.units, ps),
        "nzbalanced": pt.part_loads(pt.balanced_cuts(load, ps, "monotone"), ["p"]),
    }
    direct = reduce(
        lambda a, b: a.unionByName(b),
        [pt.load_summary(x, ["p"]).select("p", F.lit(s).alias("strategy"), "efficiency") for s, x in routes.items()],
    )
    given = bs.efficiencies(load.units, ps, 0).filter("b = 0")
    return bs.cross_check(direct, given, ["p", "strategy"], "efficiency")


@query(
    "reproduce_register",
    oracle=VECTORS_SQL + """, m AS (SELECT vector, count(*) AS n_units, sum(n) AS n_records FROM vectors GROUP BY vector),
      e AS (SELECT 'documents' AS vector, count(*) AS n_units, sum(length(text)) AS n_records FROM documents UNION ALL
            SELECT 'users', count(DISTINCT user_id), count(*) FROM events UNION ALL
            SELECT 'customers', count(*), (SELECT count(*) FROM lineitem) FROM customer)
      SELECT m.vector, m.n_units, m.n_records, e.n_units AS want_n_units, e.n_records AS want_n_records,
        coalesce(m.n_units = e.n_units AND abs(m.n_records - e.n_records) <= 0.01 * e.n_records, false) AS ok
      FROM m LEFT JOIN e ON e.vector = m.vector""",
    ints="n_records want_n_records",
)
def reproduce_register(spark, d):
    """Measured unit and record totals against totals counted at the source."""
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    rows = [
        docs.selectExpr("'documents' AS vector", "1 AS u", "CAST(length(text) AS BIGINT) AS r"),
        table(spark, d, "customer").selectExpr("'customers' AS vector", "1 AS u", "0L AS r"),
        table(spark, d, "lineitem").selectExpr("'customers' AS vector", "0 AS u", "1L AS r"),
        events.selectExpr("'users' AS vector", "0 AS u", "1L AS r"),
        events.select("user_id").distinct().selectExpr("'users' AS vector", "1 AS u", "0L AS r"),
    ]
    expected = reduce(lambda a, b: a.union(b), rows).groupBy("vector").agg(
        F.expr("sum(u) AS n_units"), F.expr("sum(r) AS n_records")
    )
    measured = di.totals(all_vectors(spark, d), ["vector"]).select("vector", "n_units", "n_records")
    return quality.reproduction(measured, expected, "vector", {"n_units": 0.0, "n_records": 0.01})
