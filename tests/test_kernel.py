import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions.scalars import order_bits
from talus.operators import kernel as k
from talus.operators import records as rec
from talus.plans import load_all

RECORDS = [
    # ties on t: the dense id decides, then the value
    (0, 1, 2.0, 30.0), (0, 0, 2.0, 10.0), (0, 0, 5.0, 20.0), (0, 1, 5.0, 500.0), (0, 1, 5.0, 40.0),
    (1, 0, 1.0, 7.0),  # single record
    (2, 0, 3.0, 1.0), (2, 0, 3.0, 9.0),  # equal times
    (3, 9, 1.0, 1.0),  # dropped id
]
LOOKUP = [(0, 0, 1.0, 0.0, 5.0, 100.0), (1, 0, 0.5, 1.0, 5.0, 100.0), (9, -1, 1.0, 0.0, -1e30, 1e30)]


@pytest.fixture(scope="module")
def frames(spark):
    records = spark.createDataFrame(RECORDS, "row_index bigint, dense_id int, t double, value double")
    lookup = spark.createDataFrame(LOOKUP, "dense_id int, slot int, vscale double, voffset double, lo double, hi double")
    return records, lookup


def test_kernel_semantics(frames):
    rows = {r["row_index"]: r for r in k.kernel(*frames).collect()}
    assert set(rows) == {0, 1, 2}
    a = rows[0]
    values = [(2.0, 10.0), (2.0, 16.0), (5.0, 20.0), (5.0, 21.0), (5.0, 100.0)]
    vs = [v for _, v in values]
    assert a["count"] == 5 and a["min"] == 10.0 and a["max"] == 100.0
    assert a["first"] == 10.0 and a["last"] == 100.0
    mean = sum(vs) / 5
    assert a["mean"] == pytest.approx(mean)
    assert a["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vs) / 5))
    mt = sum(t for t, _ in values) / 5
    slope = sum((t - mt) * (v - mean) for t, v in values) / sum((t - mt) ** 2 for t, _ in values)
    assert a["slope"] == pytest.approx(slope)
    assert rows[1]["std"] == 0.0 and rows[1]["slope"] is None
    assert rows[2]["slope"] is None and rows[2]["first"] == 5.0 and rows[2]["last"] == 9.0


def test_matrix_marks_empty_cells(spark, frames):
    units = spark.range(5).withColumnRenamed("id", "row_index")
    rows = {r["row_index"]: r for r in k.feature_matrix(k.kernel(*frames), units, 2).collect()}
    assert len(rows) == 5 and len(rows[0]) == 1 + 16
    assert rows[4]["s0_count"] == 0.0 and math.isnan(rows[4]["s0_mean"]) and math.isnan(rows[0]["s1_last"])


def test_result_does_not_depend_on_partitioning(spark, frames):
    records, lookup = frames
    base = k.kernel(records, lookup)
    for n in (1, 3, 16):
        assert k.feature_differences(base, k.kernel(records.repartition(n), lookup), 1e-12).count() == 0


def test_differences_are_found(frames):
    records, lookup = frames
    other = k.kernel(records.filter("NOT (row_index = 2 AND value = 9.0)"), lookup)
    assert [(r["row_index"], r["slot"]) for r in k.feature_differences(k.kernel(records, lookup), other, 1e-9).collect()] == [(2, 0)]


def test_stress_lookups_and_checks(frames):
    records, lookup = frames
    assert k.kernel(records, k.whitelist_none(lookup)).count() == 0
    assert k.kernel(records, k.whitelist_all(lookup, 2)).select("slot").distinct().count() == 2
    row = k.sentinel_violations(k.kernel(records, lookup)).first()
    assert (row["n_single"], row["n_single_with_spread"], row["n_single_with_slope"], row["n_empty_cells"]) == (1, 0, 0, 0)
    work = {r["idx"]: (r["n"], r["k"]) for r in k.unit_work(
        records.select(F.col("row_index").alias("idx")).distinct(), records, lookup).collect()}
    assert work == {0: (5, 5), 1: (1, 1), 2: (2, 2), 3: (1, 0)}


def test_window_prefix_check_finds_a_lost_record(frames):
    records, _ = frames
    window = rec.within(records, 4.0)
    assert rec.prefix_violations(records, window, 4.0).count() == 0
    broken = window.filter("NOT (row_index = 0 AND dense_id = 0)")
    assert [(r["row_index"], r["n_diff"]) for r in rec.prefix_violations(records, broken, 4.0).collect()] == [(0, 1)]


def test_order_bits_order_as_doubles(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(300), 10.0 ** rng.uniform(-300, 300, 300), 2.0 ** np.arange(-60, 60), -(2.0 ** np.arange(-60, 60))])
    x = np.concatenate([x, np.nextafter(x, 1e308), [0.0, -0.0, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", order_bits(F.col("x")).alias("bits"))
    rows = [(r["x"], r["bits"]) for r in df.collect()]
    finite = sorted([r for r in rows if abs(r[0]) >= 2.0**-1022 or r[0] == 0], key=lambda r: r[0])
    for (a, p), (b, q) in zip(finite, finite[1:]):
        assert (p < q) if a < b else (p == q)
    assert max(b for v, b in rows if v == v) < next(b for v, b in rows if v != v)
    assert all(b == 0 for v, b in rows if abs(v) < 2.0**-1022)


def test_first_and_last_break_ties_by_id_and_value(spark):
    """Ties in time, id and stored value, in any order and spread over partitions, against a plain sort."""
    rng = np.random.default_rng(6)
    records = [(int(u), float(t), int(i), float(v)) for u, t, i, v in zip(rng.integers(0, 3, 400), rng.integers(-1, 3, 400) / 3, rng.integers(0, 3, 400), rng.integers(-3, 3, 400) / 7)]
    lookup = [(0, 0, 2.0, 0.0, -50.0, 50.0), (1, 0, -1.0, 1.0, -50.0, 50.0), (2, 0, 1.0, 0.0, -50.0, 50.0)]
    df = spark.createDataFrame(records, "row_index bigint, t double, dense_id int, value double").repartition(7)
    known = spark.createDataFrame(lookup, "dense_id int, slot int, vscale double, voffset double, lo double, hi double")
    by_id = {r[0]: r for r in lookup}
    for row in k.kernel(df, known).collect():
        own = sorted(r[1:] for r in records if r[0] == row["row_index"])
        stored = lambda r: float(np.float32(r[2])) * by_id[r[1]][2] + by_id[r[1]][3]
        assert row["first"] == stored(own[0]) and row["last"] == stored(own[-1])


def test_kernel_sorts_nothing(spark, sf_dir):
    plan = load_all()[0]["kernel_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_large_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 0.5, 1 << 26, 1.0)], "row_index bigint, t double, dense_id int, value double")
    known = spark.createDataFrame([(1 << 26, 0, 1.0, 0.0, 0.0, 9.0)], "dense_id int, slot int, vscale double, voffset double, lo double, hi double")
    with pytest.raises(Exception, match="26 bits"):
        k.kernel(df, known).collect()
