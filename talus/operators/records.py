"""Event records of the cohort: extraction, dictionary, windows, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import hours_between, is_finite
from talus.operators.distribution import size_histogram
from talus.operators.prefix import BLOCK_ROWS, block_scan, dense_index
from talus.operators.skew import salted_join
from talus.session import broadcast_counted

# Observation windows in hours, trims in percent, record size.
WINDOWS = {"W6": 6.0, "W12": 12.0, "W24": 24.0, "W48": 48.0, "Wfull": None}
TRIM_PERCENTS = (0, 1, 5, 10)
BYTES_PER_RECORD = 12


def in_stay(source: DataFrame, cohort: DataFrame, key: str, name: str) -> DataFrame:
    """Records of one source inside the stay interval, both ends included.

    A plain join, unless the stays are few, reads the source once: what follows
    groups by other keys, so the skew split of the adaptive join spreads a stay with very many records.
    """
    stays = cohort.select(key, "row_index", "intime", "outtime")
    rows = source.filter(F.col("valuenum").isNotNull()).select(key, "itemid", "charttime", "valuenum")
    return (
        rows.join(broadcast_counted(stays), key)
        .filter(F.col("charttime").between(F.col("intime"), F.col("outtime")))
        .select(
            "row_index",
            "itemid",
            hours_between(F.col("intime"), F.col("charttime")).alias("t"),
            F.col("valuenum").alias("value"),
            F.lit(name).alias("source"),
        )
    )


def extract(
    cohort: DataFrame, chartevents: DataFrame, labevents: DataFrame, chart_items: DataFrame | None = None
) -> DataFrame:
    """Chart records by stay and lab records by admission, in one relation.

    With ``chart_items`` (code, itemid) the chart's ``itemid`` holds a code, which
    only the records inside a stay look up.
    """
    chart = in_stay(chartevents, cohort, "stay_id", "chart")
    if chart_items is not None:
        chart = chart.withColumnRenamed("itemid", "code").join(chart_items, "code").select(chart.columns)
    return chart.unionByName(in_stay(labevents, cohort, "hadm_id", "lab"))


def dictionary(records: DataFrame, d_items: DataFrame, d_labitems: DataFrame) -> DataFrame:
    """Dense ids (chart items first), labels and record counts.

    One row per item: the numbering window sees the item list, not records.
    """
    items = records.groupBy("source", "itemid").agg(F.count(F.lit(1)).alias("n_records"))
    numbered = items.withColumn(
        "dense_id", (F.row_number().over(Window.orderBy("source", "itemid")) - 1).cast("int")
    )
    chart = d_items.select(
        F.lit("chart").alias("source"), "itemid", "label", "param_type", "category"
    )
    lab = d_labitems.select(
        F.lit("lab").alias("source"), "itemid", "label", F.lit(None).cast("string").alias("param_type"), "category"
    )
    return numbered.join(chart.unionByName(lab), ["source", "itemid"], "left").select(
        "dense_id", "source", "itemid", "label", "param_type", "category", "n_records"
    )


def encode(records: DataFrame, items: DataFrame) -> DataFrame:
    """(row_index, dense_id, t, value); the item list is counted before it is broadcast."""
    ids = items.select("source", "itemid", "dense_id")
    return records.join(broadcast_counted(ids), ["source", "itemid"]).select(
        "row_index", "dense_id", "t", "value"
    )


def profile(records: DataFrame) -> DataFrame:
    """Record count, value and time ranges, and records that must not exist."""
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        F.min("value").alias("v_min"),
        F.max("value").alias("v_max"),
        F.count_if((F.col("t") < 0) | ~is_finite(F.col("value"))).alias("n_bad"),
    )


def within(records: DataFrame, hours: float | None) -> DataFrame:
    """Half-open observation window [0, hours)."""
    return records if hours is None else records.filter(F.col("t") < hours)


def _window_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("row_index").agg(
        *[
            (F.count(F.lit(1)) if hours is None else F.count_if(F.col("t") < hours)).alias(name)
            for name, hours in WINDOWS.items()
        ]
    )


def unit_counts(cohort: DataFrame, records: DataFrame) -> DataFrame:
    """Records per stay for every window in one pass, empty stays included."""
    counts = _window_counts(records)
    return (
        cohort.select(F.col("row_index").alias("idx"))
        .join(counts.withColumnRenamed("row_index", "idx"), "idx", "left")
        .na.fill(0, list(WINDOWS))
    )


def window_variants(cohort: DataFrame, records: DataFrame) -> DataFrame:
    """Size of every window variant: units, records, empty units, bytes."""
    wide = unit_counts(cohort, records)
    sums = wide.agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.sum(w).alias(f"{w}_n") for w in WINDOWS],
        *[F.count_if(F.col(w) == 0).alias(f"{w}_e") for w in WINDOWS],
    )
    rows = [
        F.struct(
            F.lit(w).alias("variant"),
            F.col("n_units"),
            F.col(f"{w}_n").alias("n_records"),
            F.col(f"{w}_e").alias("n_empty"),
            (8 * (F.col("n_units") + 1) + BYTES_PER_RECORD * F.col(f"{w}_n")).alias("bytes"),
        )
        for w in WINDOWS
    ]
    return sums.select(F.inline(F.array(*rows)))


def offsets(units: DataFrame) -> DataFrame:
    """(idx, n, start, stop): ragged-array offsets of a (idx, n) unit table."""
    scanned = block_scan(units, F.floor(F.col("idx") / BLOCK_ROWS), [F.col("idx")], {"stop": F.col("n")})
    return scanned.select("idx", "n", (F.col("stop") - F.col("n")).alias("start"), "stop")


def size_matched(units: DataFrame, target: int) -> DataFrame:
    """Shortest prefix of the unit order that holds ``target`` records."""
    return offsets(units).filter(F.col("start") < target).select("idx", "n")


def shape_trimmed(units: DataFrame, percent: int) -> DataFrame:
    """Drop the largest ``percent`` % of units (percent_rank over size, descending).

    The rank of a size is the number of larger units, read off the size
    histogram; the kept sizes are therefore all up to one threshold.
    """
    sizes = size_histogram(units)
    n = units.agg(F.count(F.lit(1)).alias("units"))
    ranked = sizes.crossJoin(F.broadcast(n)).withColumn(
        "pr", F.coalesce((F.col("units") - F.col("cf")) / F.nullif(F.col("units") - 1, F.lit(0)), F.lit(0.0))
    )
    limit = ranked.filter(F.col("pr") >= percent / 100.0).agg(F.max("n").alias("limit"))
    return units.crossJoin(F.broadcast(limit)).filter("n <= limit").select("idx", "n")


def expand(rows: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """(idx, start, stop) -> one (idx, pos) row per record.

    Long units are first cut into pieces and spread over the cluster, so a unit
    holding most of the records is expanded by many tasks. Units without
    records yield nothing.
    """
    filled = rows.filter("stop > start")
    pieces = filled.select(
        "idx",
        "stop",
        F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(piece))).alias("from"),
    ).repartition("idx", "from")
    upto = F.least(F.col("from") + piece, F.col("stop")) - 1
    return pieces.select("idx", F.explode(F.sequence(F.col("from"), upto)).alias("pos"))


def source_counts(records: DataFrame, k_chart: int) -> DataFrame:
    """Chart and lab records per unit, told apart by the dense id range."""
    return records.groupBy("row_index").agg(
        F.count_if(F.col("dense_id") < k_chart).alias("n_chart"),
        F.count_if(F.col("dense_id") >= k_chart).alias("n_lab"),
    )


def csr_order(records: DataFrame) -> DataFrame:
    """Records in the canonical ragged-array order, range partitioned by unit.

    The full key decides the ranges, so one large unit spans several tasks.
    """
    order = ["row_index", "t", "dense_id", "value"]
    return records.repartitionByRange(*order).sortWithinPartitions(*order)


def csr_positions(records: DataFrame) -> DataFrame:
    """Position of every record inside its unit, from one global numbering.

    No window per unit: a unit of any size is numbered by the range sort, and
    only the first number of each unit is joined back.
    """
    numbered = dense_index(records, [F.col(c) for c in ("row_index", "t", "dense_id", "value")], "pos")
    starts = numbered.groupBy("row_index").agg(F.min("pos").alias("start"))
    joined = salted_join(numbered, starts, "row_index", ["pos"])
    return joined.withColumn("rn", F.col("pos") - F.col("start") + 1).drop("pos", "start")


def prefix_violations(full: DataFrame, window: DataFrame, hours: float) -> DataFrame:
    """Per unit: records that break "window variant = prefix of the full one".

    Times are compared in single precision, as stored. Both relations are
    reduced to per-record multiplicities before they meet.
    """
    key = ["row_index", "dense_id", F.col("t").cast("float").alias("t"), F.col("value").cast("float").alias("value")]
    names = ["row_index", "dense_id", "t", "value"]
    expected = full.filter(F.col("t").cast("float") < F.lit(hours).cast("float")).select(*key)
    both = expected.withColumn("d", F.lit(1)).unionByName(window.select(*key).withColumn("d", F.lit(-1)))
    return (
        both.groupBy(*names).agg(F.sum("d").alias("d")).filter("d <> 0")
        .groupBy("row_index").agg(F.sum(F.abs("d")).alias("n_diff"))
    )
