"""Scaling regime of a workload and what a better partitioner could gain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import safe_ratio
from talus.operators.partitioners import Pairs, Span, Workload, imbalance
from talus.session import literal_rows

# Measured effect sizes and defaults of the scaling study.
PLACEMENT_RUNG = 0.084
PLACEMENT_SPAN = 0.320
NOISE_FLOOR = 0.0239
THREADS_PER_RANK = 8
CORES_PER_NODE = 16
TRANSFERRED_P_STAR = 56
P_MAX = 8192
CURVE_P_MAX = 4096
FAR_FIELD = (8192, 16384, 32768)
MEASURABLE_P, MEASURABLE_T = 96, 16

REGIME_NAMES = {"I": "placement-limited", "II": "partition-limited", "III": "atomicity-limited"}
ADVICE = {
    "I": "Place executors well first; cutting the data differently changes less than placement does.",
    "II": "Cut by records instead of by unit count; the gain grows with the number of partitions.",
    "III": "The largest unit exceeds an average partition; only splitting units helps from here on.",
}
ACTIONS = {
    "I": (
        "Pin workers so that neighbours in the numbering run on one socket",
        "Take the map of cores to sockets from the machine instead of guessing it",
        "Leave the cut rule as it is: placement moves more than any rule can at this p",
    ),
    "II": (
        "Cut contiguously at equal shares of records or modelled work",
        "Keep dealt (non-contiguous) rules out of two-stage cuts",
        "Prefer rank counts that divide the number of units",
        "Keep placement pinned: its cost is still there, only smaller than that of the cut",
    ),
    "III": (
        "Expect imbalance to rise in proportion to p: an average part is smaller than the largest unit",
        "Split large units over several workers and merge their partial results",
        "Do not add workers beyond p_atom without splitting: whole units cannot fill them",
    ),
}


def ceilings(load: Workload, pairs: Pairs) -> DataFrame:
    """Fractional gain of a record-balanced over an equal-count cut."""
    return imbalance(load, pairs).withColumn("ceiling", F.col("imb_block") / F.col("imb_balanced") - 1.0)


def search_grid(n_units: int, threads: int = THREADS_PER_RANK, p_max: int = P_MAX) -> list[tuple[int, int]]:
    """Rank counts worth testing: p = ranks * threads up to half the units."""
    return [(r, threads) for r in range(1, p_max // threads + 1) if r * threads <= n_units // 2]


def first_crossing(curve: DataFrame, threshold: float = PLACEMENT_RUNG, keys: tuple[str, ...] = ()) -> DataFrame:
    """Smallest p whose ceiling reaches the threshold (NULL when none does), for each of ``keys``."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("ceiling") >= threshold, F.col("p"))).alias("p_star"))


def p_stars(load: Workload, threads: int = THREADS_PER_RANK, p_max: int = P_MAX) -> DataFrame:
    """(w, n_units, total, largest, p_star) of every workload, over the whole grid in one plan."""
    schema = "n_units bigint, total bigint, largest bigint"
    known = load.rows(lambda s: [(s.n_units, s.total, s.largest)], schema)
    stars = first_crossing(ceilings(load, lambda s: search_grid(s.n_units, threads, p_max)), keys=load.keys)
    return known.join(stars, list(load.keys), "left") if load.keys else known.crossJoin(stars)  # one row each


def find_p_star(load: Workload, threads: int = THREADS_PER_RANK, p_max: int = P_MAX) -> int | None:
    """p* of a single workload as a number."""
    return p_stars(load, threads, p_max).first()["p_star"]


def regime(p: Column, p_star: Column, p_atom: Column) -> Column:
    return (
        F.when(p_star.isNotNull() & (p < p_star), "I").when(p < p_atom, "II").otherwise("III")
    )


def _named(code: Column, names: dict) -> Column:
    expr = None
    for key, text in names.items():
        value = F.array(*[F.lit(t) for t in text]) if isinstance(text, tuple) else F.lit(text)
        expr = F.when(code == key, value) if expr is None else expr.when(code == key, value)
    return expr


def split_cores(p: int, threads: int) -> tuple[int, int]:
    """Ranks and threads per rank that p cores are asked as."""
    return max(1, p // threads), min(threads, p)


def advise(load: Workload, ps: list[int], threads: int = THREADS_PER_RANK, p_star: int | None = None) -> DataFrame:
    """Regime, advice, actions and bounded gain for each requested partition count, and workload of a batch.

    ``threads`` is honoured for every p. Requests beyond half the units get no
    ceiling. Pass ``p_star`` to reuse a search. Everything is one plan: p* comes
    from the whole grid as a relation.
    """
    asked = [(int(p), *split_cores(p, threads)) for p in ps]
    requests = load.rows(lambda s: asked, "p bigint, r bigint, t bigint")
    fitting = lambda s: sorted({(r, t) for _, r, t in asked if r * t <= s.n_units // 2})
    keys = list(load.keys)
    gains = ceilings(load, fitting).select(*keys, "r", "t", "ceiling")
    joined = requests.join(gains, [*keys, "r", "t"], "left")
    if p_star is None:
        known = p_stars(load, threads)
    else:
        known = load.rows(lambda s: [(s.n_units, s.total, s.largest, int(p_star))], "n_units bigint, total bigint, largest bigint, p_star bigint")
    joined = joined.join(F.broadcast(known), keys) if keys else joined.crossJoin(F.broadcast(known))  # one row a workload
    p_atom = safe_ratio(F.col("total"), F.col("largest"))
    code = regime(F.col("p"), F.col("p_star"), p_atom)
    return joined.select(
        *keys,
        "p",
        "p_star",
        code.alias("regime"),
        _named(code, REGIME_NAMES).alias("regime_name"),
        _named(code, ADVICE).alias("advice"),
        _named(code, ACTIONS).alias("actions"),
        "ceiling",
        (F.col("ceiling") / PLACEMENT_RUNG).alias("ceiling_vs_rung"),
        F.coalesce(F.col("ceiling") > NOISE_FLOOR, F.lit(False)).alias("resolvable"),
        (F.col("p") / p_atom).alias("p_over_p_atom"),
    )


def summary_advice(spark, n_units: int, n_records: int, largest: int, ps: list[int]) -> DataFrame:
    """Regime when only totals are known: p_atom is exact, p* is transferred."""
    rows = literal_rows(spark, [(int(p),) for p in ps], "p bigint")
    p_atom = F.lit(n_records / largest)
    code = regime(F.col("p"), F.lit(TRANSFERRED_P_STAR), p_atom)
    return rows.select(
        "p",
        code.alias("regime"),
        _named(code, REGIME_NAMES).alias("regime_name"),
        F.lit(n_records / n_units).alias("mean_unit"),
        p_atom.alias("p_atom"),
        (F.col("p") / p_atom).alias("p_over_p_atom"),
    )


def factorisations(ps: Iterable[int], max_threads: int = MEASURABLE_T) -> list[tuple[int, int]]:
    """(ranks, threads) of every p with up to ``max_threads`` threads per rank."""
    return [(p // t, t) for p in ps for t in range(1, min(max_threads, p) + 1) if p % t == 0]


def whole_curve(span: Span, p_max: int = CURVE_P_MAX, far: tuple[int, ...] = FAR_FIELD, max_threads: int = MEASURABLE_T) -> list[tuple[int, int]]:
    """Every factorisation of p = 2..p_max and of the far field that a workload has units for."""
    return [(r, t) for r, t in factorisations([*range(2, p_max + 1), *far], max_threads) if r <= span.n_units and t <= span.n_units]


def curve(load: Workload, pairs: Pairs) -> DataFrame:
    """Imbalance, block loss and ceiling per (p, ranks, threads)."""
    measurable = (F.col("p") <= MEASURABLE_P) & (F.col("t") <= MEASURABLE_T)
    return imbalance(load, pairs).select(
        *load.keys,
        "p",
        F.col("r").alias("n_ranks"),
        F.col("t").alias("n_threads"),
        "imb_block",
        "imb_balanced",
        (100.0 * (1.0 - 1.0 / F.col("imb_block"))).alias("loss_block_pct"),
        (100.0 * (F.col("imb_block") / F.col("imb_balanced") - 1.0)).alias("ceiling_pct"),
        measurable.alias("measurable"),
    )


def crossings(points: DataFrame, thresholds: dict[str, float], threads: int = THREADS_PER_RANK) -> DataFrame:
    """First p on the ``threads`` line whose ceiling reaches each threshold."""
    line = points.filter(F.col("n_threads") == threads)
    return line.agg(
        *[F.min(F.when(F.col("ceiling_pct") >= 100 * v, F.col("p"))).alias(name) for name, v in thresholds.items()]
    )


def factorisation_spread(points: DataFrame) -> DataFrame:
    """How much the block imbalance depends on how p is factorised."""
    return (
        points.groupBy("p")
        .agg(F.count(F.lit(1)).alias("n_ways"), F.min("imb_block").alias("lo"), F.max("imb_block").alias("hi"))
        .withColumn("spread_pct", 100.0 * (F.col("hi") / F.col("lo") - 1.0))
    )


def floor_audit(points: DataFrame, load: Workload) -> DataFrame:
    """No cut may beat the atomic floor p * max / N; counts violations."""
    floor = F.col("p") * F.lit(float(load.largest)) / F.lit(float(load.total))
    slack = F.least("imb_block", "imb_balanced") - floor
    return points.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(slack < -1e-12).alias("n_violations"),
        F.min(slack).alias("min_slack"),
    )


def atomic_register(load: Workload, registered: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(quantity, measured, registered, ok): units, records, largest unit and p_atom against registered values."""
    known = load.units.agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_records"), F.max("n").alias("largest"))
    known = known.withColumn("p_atom", safe_ratio(F.col("n_records"), F.col("largest")))
    names = ["n_units", "n_records", "largest", "p_atom"]
    long = known.select(*[F.col(n).cast("double") for n in names]).unpivot([], names, "quantity", "measured")
    gap = F.abs(F.col("measured") - F.col("registered"))
    ok = F.coalesce(gap <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("registered"))), F.lit(False))
    return long.join(registered.select("quantity", "registered"), "quantity", "left").withColumn("ok", ok)  # four rows


def atomic_floors(load: Workload, ps: Iterable[int] = FAR_FIELD) -> DataFrame:
    """(p, floor): the imbalance that no cut can beat, p * largest / records."""
    schema = "p bigint, largest bigint, total bigint"
    rows = load.rows(lambda s: [(int(p), s.largest, s.total) for p in ps], schema)
    return rows.select(*load.keys, "p", safe_ratio(F.col("p") * F.col("largest"), F.col("total")).alias("floor"))


def speedup_against_first(points: DataFrame, order: str, value: str) -> DataFrame:
    first = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumn("speedup", F.col(value) / F.first(value).over(first))
