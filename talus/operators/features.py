"""Feature specification: which variables are kept and how they are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.scalars import harmonise, safe_ratio
from talus.operators.quantiles import grouped_quantiles
from talus.operators.skew import salted_join
from talus.session import broadcast_counted, cut_lineage

# Coverage floor of filled slots, their number, clip quantiles,
# coverage warnings, size of the resolved variable set, open bound.
FILL_FLOOR = 0.25
FILL_SLOTS = 4
CLIP_QUANTILES = (0.001, 0.999)
CORE_WARN, CORE_ASSERT = 0.50, 0.05
N_VARIABLES = 20
OPEN_BOUND = 1e30
COVERAGE_HOURS = 24.0


def plausible() -> Column:
    """Exclusive plausibility gate on raw units."""
    return (F.col("value") > F.col("raw_lo")) & (F.col("value") < F.col("raw_hi"))


def check_varmap(varmap: DataFrame, items: DataFrame) -> DataFrame:
    """Variable map resolved against the dictionary, with hit/source flags."""
    found = items.select(
        "itemid", "dense_id", F.col("source").alias("dict_source"),
        F.col("label").alias("dict_label"), "param_type", "category",
    )
    return (
        varmap.join(found, "itemid", "left")
        .withColumn("dict_hit", F.col("dense_id").isNotNull().cast("int"))
        .withColumn("src_agrees", F.coalesce(F.col("dict_source") == F.col("src"), F.lit(False)).cast("int"))
        .drop("dict_source")
    )


def training_records(records: DataFrame, train: DataFrame, checked: DataFrame) -> DataFrame:
    """Ungated training records joined to their variable; shared by all fits."""
    mapping = checked.filter("dict_hit = 1").select(
        "dense_id", "variable", "itemid", "vscale", "voffset", "raw_lo", "raw_hi"
    )
    mapped = records.join(broadcast_counted(mapping), "dense_id")
    return salted_join(mapped, train.select("row_index"), "row_index", ["t", "dense_id", "value"])


def coverage(training: DataFrame, train: DataFrame, varmap: DataFrame, hours: float = COVERAGE_HOURS) -> DataFrame:
    """Share of training units with at least one plausible record per variable."""
    seen = training.filter((F.col("t") >= 0.0) & (F.col("t") < hours) & plausible())
    per_unit = seen.groupBy("variable", "row_index").agg(F.count(F.lit(1)).alias("cnt"))
    per_variable = grouped_quantiles(
        per_unit,
        ["variable"],
        {"median_per_stay": ("cnt", 0.5)},
        [F.count(F.lit(1)).alias("n_stays"), F.sum("cnt").alias("n_records")],
    )
    variables = varmap.groupBy("variable").agg(F.min("tier").alias("tier"), F.min("pref").alias("pref"))
    n_train = train.agg(F.count(F.lit(1)).alias("n_train"))
    return (
        variables.join(per_variable, "variable", "left")
        .crossJoin(F.broadcast(n_train))
        .na.fill(0, ["n_stays", "n_records"])
        .withColumn("cov", safe_ratio(F.col("n_stays"), F.col("n_train")))
        .drop("n_train")
    )


def choose(covered: DataFrame, floor: float = FILL_FLOOR, slots: int = FILL_SLOTS) -> DataFrame:
    """Core variables plus the best-covered pool variables above the floor."""
    core = covered.filter("tier = 'core'").select("variable", F.lit("core").alias("tier"), "cov", F.lit(0).alias("ord"))
    ranked = Window.orderBy(F.desc("cov"), F.asc("pref"), F.asc("variable"))
    fill = (
        covered.filter((F.col("tier") == "pool") & (F.col("cov") >= floor))
        .withColumn("rn", F.row_number().over(ranked))
        .filter(F.col("rn") <= slots)
        .select("variable", F.lit("fill").alias("tier"), "cov", F.lit(1).alias("ord"))
    )
    return core.unionByName(fill)


def assign_slots(chosen: DataFrame) -> DataFrame:
    order = Window.orderBy("ord", "variable")
    return chosen.withColumn("slot", (F.row_number().over(order) - 1).cast("int"))


def _fit(training: DataFrame, chosen: DataFrame) -> DataFrame:
    kept = training.join(broadcast_counted(chosen.select("variable")), "variable", "left_semi")
    return kept.filter(plausible()).withColumn(
        "h", harmonise(F.col("value"), F.col("vscale"), F.col("voffset"))
    )


def clip_ranges(training: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exact clip quantiles and observed range per item (whole stay)."""
    return grouped_quantiles(
        _fit(training, chosen),
        ["variable", "itemid", "dense_id", "vscale", "voffset"],
        {"lo": ("h", CLIP_QUANTILES[0]), "hi": ("h", CLIP_QUANTILES[1])},
        [
            F.count(F.lit(1)).alias("n_train_records"),
            F.min("h").alias("observed_min"),
            F.max("h").alias("observed_max"),
        ],
    )


def fallback_ranges(training: DataFrame, chosen: DataFrame) -> DataFrame:
    """Clip quantiles pooled over all items of a variable."""
    return grouped_quantiles(
        _fit(training, chosen),
        ["variable"],
        {"lo": ("h", CLIP_QUANTILES[0]), "hi": ("h", CLIP_QUANTILES[1])},
        [F.count(F.lit(1)).alias("n_train_records")],
    )


def fallback_items(checked: DataFrame, ranges: DataFrame, fallback: DataFrame) -> DataFrame:
    """Items of fitted variables that have no range of their own."""
    pooled = fallback.select("variable", F.col("lo").alias("fallback_lo"), F.col("hi").alias("fallback_hi"))
    return (
        checked.join(pooled, "variable")
        .join(ranges.select("itemid"), "itemid", "left_anti")
        .select("variable", "itemid", "dense_id", "fallback_lo", "fallback_hi")
    )


def gate_rejects(training: DataFrame, chosen: DataFrame) -> DataFrame:
    """How many training records the plausibility gate refuses per item."""
    kept = training.join(broadcast_counted(chosen.select("variable")), "variable", "left_semi")
    return (
        kept.groupBy("variable", "itemid", "raw_lo", "raw_hi")
        .agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(~plausible()).alias("n_rejected"))
        .withColumn("frac_rejected", F.round(F.col("n_rejected") / F.col("n_raw"), 6))
    )


def warning_agreement(chartevents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Do the source's warning flags agree with the fitted clip range?"""
    bounds = ranges.select("variable", "itemid", "vscale", "voffset", "lo", "hi")
    rows = chartevents.filter(F.col("valuenum").isNotNull()).join(broadcast_counted(bounds), "itemid")
    outside = ~harmonise(F.col("valuenum"), F.col("vscale"), F.col("voffset")).between(F.col("lo"), F.col("hi"))
    warned = F.col("warning") == 1
    return (
        rows.groupBy("variable", "itemid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(warned).alias("n_warned"),
            F.count_if(outside).alias("n_outside"),
            F.count_if(warned & outside).alias("n_both"),
        )
        .withColumn("frac_warned_outside", F.round(safe_ratio(F.col("n_both"), F.col("n_warned")), 4))
    )


def kernel_lookup(
    items: DataFrame, checked: DataFrame, slots: DataFrame, ranges: DataFrame, fallback: DataFrame
) -> DataFrame:
    """One row per dense id: slot (-1 = dropped), harmonisation, clip bounds.

    Own bounds win over the variable's pooled bounds, which win over open
    bounds. All inputs are item or variable lists.
    """
    mapping = checked.select("itemid", "variable", "vscale", "voffset")
    own = ranges.select("itemid", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    pooled = fallback.select("variable", F.col("lo").alias("var_lo"), F.col("hi").alias("var_hi"))
    joined = (
        items.select("dense_id", "itemid", "label")
        .join(mapping, "itemid", "left")
        .join(slots.select("variable", "slot"), "variable", "left")
        .join(own, "itemid", "left")
        .join(pooled, "variable", "left")
    )
    origin = (
        F.when(F.col("slot").isNull(), "dropped")
        .when(F.col("own_lo").isNotNull(), "own")
        .when(F.col("var_lo").isNotNull(), "fallback")
        .otherwise("UNBOUNDED")
    )
    return joined.select(
        "dense_id",
        F.coalesce("slot", F.lit(-1)).cast("smallint").alias("slot"),
        F.coalesce("vscale", F.lit(1.0)).cast("float").alias("vscale"),
        F.coalesce("voffset", F.lit(0.0)).cast("float").alias("voffset"),
        F.coalesce("own_lo", "var_lo", F.lit(-OPEN_BOUND)).cast("float").alias("lo"),
        F.coalesce("own_hi", "var_hi", F.lit(OPEN_BOUND)).cast("float").alias("hi"),
        origin.alias("bounds_src"),
        "itemid",
        "label",
    )


def specification_checks(chosen: DataFrame, ranges: DataFrame, lookup: DataFrame) -> DataFrame:
    """Assertions over the finished specification, one row of counters."""
    kept = F.col("slot") >= 0
    on_lookup = lookup.agg(
        F.count(F.lit(1)).alias("k_total"),
        F.min("dense_id").alias("min_id"),
        F.max("dense_id").alias("max_id"),
        F.count_distinct("dense_id").alias("n_distinct"),
        F.count_if(kept).alias("n_kept_itemids"),
        F.count_distinct(F.when(kept, F.col("slot"))).alias("n_slots"),
        F.count_if(kept & ((F.col("lo") <= -1e29) | (F.col("hi") >= 1e29))).alias("n_kept_without_bounds"),
    )
    on_chosen = chosen.agg(
        F.count(F.lit(1)).alias("n_variables"),
        (F.count(F.lit(1)) * 8).alias("n_features"),
        F.count_if(F.col("cov") <= 0).alias("n_zero_coverage"),
        F.count_if((F.col("tier") == "core") & (F.col("cov") < CORE_WARN)).alias("n_core_low"),
        F.count_if((F.col("tier") == "core") & (F.col("cov") < CORE_ASSERT)).alias("n_core_empty"),
    )
    infinite = F.lit(float("inf"))
    on_ranges = ranges.agg(
        F.count_if(
            ~(F.col("lo") < F.col("hi")) | F.isnan("lo") | F.isnan("hi")
            | (F.abs("lo") == infinite) | (F.abs("hi") == infinite)
        ).alias("n_bad_ranges")
    )
    return on_lookup.crossJoin(on_chosen).crossJoin(on_ranges)  # one row each


class Specification:
    """The stages of the specification over one set of inputs.

    The joined training records feed four fits, and each fitted table is small
    and read by several later stages, so every stage is written once, on first
    use, like a published artifact.
    """

    def __init__(self, cohort: DataFrame, items: DataFrame, records: DataFrame, varmap: DataFrame):
        self.base, self.items, self.records, self.varmap = cohort, items, records, varmap
        self.checked = cut_lineage(check_varmap(varmap, items))
        self.train = cohort.filter("split = 'train'")
        self._stages: dict[str, DataFrame] = {}

    def _stage(self, name: str, build) -> DataFrame:
        if name not in self._stages:
            self._stages[name] = cut_lineage(build())
        return self._stages[name]

    @property
    def training(self) -> DataFrame:
        return self._stage("training", lambda: training_records(self.records, self.train, self.checked))

    def coverage(self) -> DataFrame:
        return self._stage("coverage", lambda: coverage(self.training, self.train, self.varmap))

    def chosen(self) -> DataFrame:
        return self._stage("chosen", lambda: choose(self.coverage()))

    def ranges(self) -> DataFrame:
        return self._stage("ranges", lambda: clip_ranges(self.training, self.chosen()))

    def fallback(self) -> DataFrame:
        return self._stage("fallback", lambda: fallback_ranges(self.training, self.chosen()))

    def lookup(self) -> DataFrame:
        slots = assign_slots(self.chosen())
        return self._stage(
            "lookup", lambda: kernel_lookup(self.items, self.checked, slots, self.ranges(), self.fallback())
        )
