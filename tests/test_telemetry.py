import pytest

from talus.operators.quantiles import medians
from talus.operators import telemetry as te
from talus.sources import files, schemas
from talus.streaming.telemetry import append_stream, follow_runs
from tests.test_sources import run_row, write_runs

BROKEN = {
    "schema_version": {"schema_version": 9}, "csr_variant": {"csr_variant": ""}, "partitioner": {"partitioner": "zigzag"},
    "schedule": {"schedule": "later"}, "row_order": {"row_order": "x"}, "stage_mode": {"stage_mode": "x"},
    "mempolicy": {"mempolicy": "x"}, "timed_region": {"timed_region": "x"}, "bitidentical": {"bitidentical": "maybe"},
    "thread_placement": {"thread_placement": "roof"}, "chunk_size_missing": {"schedule": "dynamic"},
    "chunk_size_unexpected": {"chunk_size": 4}, "partitioner_none": {"partitioner": "none"},
    "whitelist_frac": {"whitelist_frac": 1.5}, "warmup": {"repetition": 0}, "n_threads": {"n_threads": 0},
    "smt": {"n_threads": 32}, "k_iterations": {"k_iterations": 0}, "wall_time_s": {"wall_time_s": 0.0},
}


def test_each_rule_is_reported(spark, tmp_path):
    rows = [run_row(run_id=name, **change) for name, change in BROKEN.items()] + [run_row(run_id="good")]
    write_runs(tmp_path / "a.csv", rows)
    runs = spark.read.schema(schemas.RUNS).option("header", True).csv(f"{tmp_path}/a.csv")
    found = {r["run_id"]: r["problems"] for r in te.validate_runs(runs).collect()}
    assert found["good"] == []
    for name in BROKEN:
        assert name in found[name], (name, found[name])


def test_old_schema_has_no_placement_rule(spark, tmp_path):
    write_runs(tmp_path / "a.csv", [run_row(schema_version=1, thread_placement="roof")])
    assert files.load_runs(spark, f"{tmp_path}/a.csv").count() == 1


def test_layouts(spark):
    rows = []
    for run, sockets in {"g": [0, 0, 1, 1], "a": [0, 1, 0, 1], "s": [0, 0], "one": [1]}.items():
        rows += [(run, tid, s) for tid, s in enumerate(sockets)]
    threads = spark.createDataFrame(rows, "run_id string, tid int, socket int")
    got = {r["run_id"]: (r["layout"], r["transitions"]) for r in te.thread_layout(threads).collect()}
    assert got == {"g": ("grouped", 1), "a": ("alternating", 3), "s": ("single", 0), "one": ("single", 0)}


def test_interpolation_and_rolling(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 100.0), (20.0, 0.0)], "x double, y double")
    wanted = spark.createDataFrame([(5.0,), (10.0,), (19.0,)], "x double")
    assert [r["y"] for r in te.interpolate(points, wanted, "x", "y").orderBy("x").collect()] == pytest.approx([50.0, 100.0, 10.0])
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 9, 3, 7])], "i int, v double")
    assert [r["rolling"] for r in te.rolling_median(series, "i", "v", 3).orderBy("i").collect()] == [3.0, 5.0, 3.0, 7.0, 5.0]


def test_launch_order_flags_mismatch(spark):
    runs = spark.createDataFrame(
        [("1-0-50-000001", "W24", "dynamic"), ("1-0-70-000001", "Wfull", "precomputed")],
        "run_id string, csr_variant string, schedule string",
    )
    plan = spark.createDataFrame([(0, "W24", "dynamic"), (1, "W24", "precomputed"), (2, "W24", "dynamic")],
                                 "pos int, csr_variant string, schedule string")
    assert [r["ok"] for r in te.launch_order(runs, plan).orderBy("pos").collect()] == [True, False, False]


def test_stream_keeps_valid_rows_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    inbox.mkdir()
    write_runs(inbox / "a.csv", [run_row(), run_row(run_id="bad", wall_time_s=0.0)])
    for extra in (None, "b.csv"):
        if extra:
            write_runs(inbox / extra, [run_row(run_id="later")])
        append_stream(follow_runs(spark, str(inbox)), str(out), str(mark)).awaitTermination()
    assert sorted(r["run_id"] for r in spark.read.parquet(str(out)).collect()) == ["1-0-9-000001", "later"]


def test_paired_halves(spark):
    """Lower half up, upper half down, one thread without a pair and one against the rule."""
    gains = [1.5, 2.5, -0.5, 1.0, -1.0, -2.0, -3.0, 0.0]
    rows = [(i, g) for i, g in enumerate(gains)] + [(8, None)]
    row = te.paired_halves(spark.createDataFrame(rows, "tid int, gain_pct double")).first()
    assert (row["half"], row["n_threads"], row["low_positive"], row["high_negative"], row["n_predicted"]) == (4, 8, 3, 3, 6)
    assert row["low_mean"] == pytest.approx(1.125) and row["high_mean"] == pytest.approx(-1.5)
    assert row["penalty_pct"] == pytest.approx(1.3125) and row["consistent"]


def test_medians_read_their_rows_once_and_keep_groups_without_values(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 'hot' WHEN id < 2900 THEN 'b' ELSE NULL END AS k", "CASE WHEN id < 2900 THEN CAST(id % 777 AS DOUBLE) END AS v")
    out = medians(df, ["k"], {"m": "v"})
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    hot, other = (sorted(i % 777 for i in range(*r)) for r in ((0, 2500), (2500, 2900)))
    middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    assert {r["k"]: r["m"] for r in out.collect()} == {"hot": middle(hot), "b": middle(other), None: None}
