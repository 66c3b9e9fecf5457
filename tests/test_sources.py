import gzip
import hashlib
import json

import numpy as np
import pytest

from talus.sinks import files as sink
from talus.sources import arrays, files, ragged, schemas


def test_gzip_csv_with_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "labevents.csv.gz"
    text = 'labevent_id,subject_id,hadm_id,specimen_id,itemid,order_provider_id,charttime,storetime,value,valuenum,valueuom,ref_range_lower,ref_range_upper,flag,priority,comments\n'
    text += '1,2,,3,50813,P1,2020-01-01 10:00:00,,1.5,1.5,mmol/L,0.5,2.0,,ROUTINE,"said ""fine"", then\nleft"\n'
    text += "2,2,7,3,50813,P1,2020-01-02 10:00:00,,___,,mmol/L,,,abnormal,STAT,\n"
    with gzip.open(path, "wt") as out:
        out.write(text)
    rows = files.read_csv_table(spark, str(path), schemas.CLINICAL["labevents"], 4).orderBy("labevent_id").collect()
    assert len(rows) == 2
    assert rows[0]["comments"] == 'said "fine", then\nleft' and rows[0]["hadm_id"] is None
    assert str(rows[0]["charttime"]) == "2020-01-01 10:00:00" and rows[1]["valuenum"] is None


def write_ragged(folder, sizes, ids, t, v):
    off = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    off.tofile(folder / "offsets.i64")
    np.array(ids, "<i4").tofile(folder / "itemid.i32")
    np.array(t, "<f4").tofile(folder / "t.f32")
    np.array(v, "<f4").tofile(folder / "value.f32")
    (folder / "meta.json").write_text(json.dumps({"n_stays": len(sizes), "n_records": int(off[-1])}, indent=2))


def test_ragged_folder(spark, tmp_path):
    sizes = [2, 0, 3]
    write_ragged(tmp_path, sizes, [1, 2, 3, 4, 5], [0.5, 1, 1.5, 2, 2.5], [9, 8, 7, 6, 5])
    rows = arrays.read_ragged(spark, str(tmp_path)).orderBy("dense_id").collect()
    assert [(r["row_index"], r["dense_id"], r["t"], r["value"]) for r in rows] == [
        (0, 1, 0.5, 9.0), (0, 2, 1.0, 8.0), (2, 3, 1.5, 7.0), (2, 4, 2.0, 6.0), (2, 5, 2.5, 5.0)]
    assert [r["n"] for r in arrays.read_offsets(spark, f"{tmp_path}/offsets.i64").orderBy("idx").collect()] == sizes
    assert {(r["entry"], r["ok"]) for r in arrays.manifest_check(spark, str(tmp_path)).collect()} == {("n_stays", True), ("n_records", True)}
    assert len(arrays.digests(spark, [f"{tmp_path}/meta.json"]).first()["sha256"]) == 64


@pytest.mark.parametrize("values, message", [([0], "two entries"), ([0, 5, 3], "decrease"), ([0, 0, 0], "empty")])
def test_bad_offsets_are_refused(spark, tmp_path, values, message):
    np.array(values, "<u4").tofile(tmp_path / "o.u32")
    with pytest.raises(ValueError, match=message):
        arrays.read_offsets(spark, str(tmp_path / "o.u32"), "u32")


def test_ragged_length_mismatch_is_refused(spark, tmp_path):
    write_ragged(tmp_path, [2, 2], [1, 2, 3], [0, 0, 0], [0, 0, 0])
    with pytest.raises(ValueError, match="disagree"):
        arrays.read_ragged(spark, str(tmp_path))


def test_ragged_parts_come_back(spark, tmp_path):
    """A unit with most of the records spans parts, units without records lie between, before and behind."""
    rng = np.random.default_rng(2)
    units = [3] * 500 + [9] * 40 + [4] * 3 + [20]
    rows = [(u, float(np.float32(t)), int(i), float(np.float32(v))) for u, t, i, v in zip(units, rng.random(len(units)), rng.integers(0, 5, len(units)), rng.random(len(units)))]
    df = spark.createDataFrame(rows, "row_index int, t double, dense_id int, value double")
    folder = str(tmp_path / "ragged")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so few rows would make one part
    try:
        arrays.write_ragged(df.repartition(5), folder, n_units=30)
    finally:
        spark.conf.unset(coalesce)
    manifest = json.loads((tmp_path / "ragged" / "parts.json").read_text())
    assert manifest["n_stays"] == 30 and manifest["n_records"] == len(rows)
    assert sum(p["first_unit"] <= 3 < p["first_unit"] + p["n_units"] for p in manifest["parts"]) > 1
    back = arrays.read_ragged(spark, folder)
    assert sorted((r["row_index"], r["t"], r["dense_id"], r["value"]) for r in back.collect()) == sorted(rows)
    checked = arrays.manifest_check(spark, folder).collect()
    assert len(checked) == 2 + 4 * len(manifest["parts"]) and all(r["ok"] for r in checked)
    spoilt = tmp_path / "ragged" / manifest["parts"][0]["folder"] / "value.f32"
    kept = spoilt.read_bytes()
    spoilt.write_bytes(kept[:-4] + b"\0\0\0\1")
    assert [r["entry"] for r in arrays.manifest_check(spark, folder).collect() if not r["ok"]] == [f"{manifest['parts'][0]['folder']}/value.f32"]
    spoilt.write_bytes(kept)
    stray = tmp_path / "ragged" / "part-000000-999"  # left behind by a task that ran twice
    stray.mkdir()
    (stray / "t.f32").write_bytes(b"junk")
    assert arrays.read_ragged(spark, folder).count() == len(rows)
    arrays.write_ragged(df.filter("t < 0"), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "parts.json").read_text())["parts"] == []


def test_manifest_of_a_whole_folder(spark, tmp_path):
    write_ragged(tmp_path, [2, 1], [1, 2, 3], [0, 1, 2], [5, 6, 7])
    names = ["offsets.i64", "itemid.i32", "t.f32", "value.f32"]
    digests = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in names}
    arrays.write_manifest(str(tmp_path / "meta.json"), {"n_stays": 2, "n_records": 4, "sha256": digests | {"t.f32": "0" * 64}})
    found = {r["entry"]: r["ok"] for r in arrays.manifest_check(spark, str(tmp_path)).collect()}
    assert found == {"n_stays": True, "n_records": False} | {n: n != "t.f32" for n in names}


def test_any_range_of_records_finds_its_units(tmp_path):
    sizes = [0, 0, 4, 0, 1, 7, 0, 0, 3, 0]
    n = sum(sizes)
    write_ragged(tmp_path, sizes, range(n), range(n), range(n))
    owner = np.repeat(np.arange(len(sizes)), sizes).tolist()
    reader = ragged._RecordReader(str(tmp_path))
    (whole,) = reader.partitions()
    assert (whole.start, whole.stop, whole.n_units) == (0, n, len(sizes))
    for a in range(n):
        for b in range(a + 1, n + 1):
            (batch,) = reader.read(ragged.Part(str(tmp_path), 100, len(sizes), a, b))
            assert batch.column("row_index").to_pylist() == [100 + u for u in owner[a:b]]
            assert batch.column("dense_id").to_pylist() == list(range(a, b))


def test_unsorted_records_are_not_written(spark, tmp_path):
    spark.dataSource.register(ragged.RaggedSource)
    rows = spark.createDataFrame([(5, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)], ragged.RECORDS).coalesce(1)
    with pytest.raises(Exception, match="not sorted"):
        rows.write.format("ragged").mode("append").save(str(tmp_path / "x"))
    assert not (tmp_path / "x" / ragged.MANIFEST).exists()


def test_lookup_is_completed(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text("dense_id,slot,vscale,voffset,lo,hi,bounds_src\n0,3,0.5,1.0,2.0,9.0,own\n2,-1,1,0,-1e30,1e30,dropped\n")
    rows = {r["dense_id"]: r for r in files.read_lookup(spark, str(path), 4).collect()}
    assert len(rows) == 4 and rows[0]["slot"] == 3 and rows[1]["slot"] == -1 and rows[3]["vscale"] == 1.0
    assert [r["dense_id"] for r in files.lookup_gaps(spark, str(path), 4).orderBy("dense_id").collect()] == [1, 3]


def run_row(**change):
    row = {f.split()[0]: "" for f in schemas.RUNS.split(", ")}
    row.update(
        schema_version=2, run_id="1-0-9-000001", job_id=1, csr_variant="W24", n_stays=5, n_records=10, paradigm="omp",
        platform="broadwell", partitioner="block", schedule="precomputed", chunk_size=-1, row_order="canonical", n_ranks=1,
        n_threads=8, smt=0, thread_placement="socket0", n_nodes=1, stage_mode="interleave", numa_balancing=-1,
        mempolicy="default", whitelist_frac=1.0, k_iterations=1, timed_region="kernel", repetition=1, warmup=0,
        wall_time_s=1.0, throughput_rec_s=10.0, work_imbalance=1.0, time_imbalance=1.0, n_records_max_thread=2,
        n_records_mean_thread=1.5, bitidentical="pass", l3_tcm=-1, l3_tca=-1, tot_cyc=-1, tot_ins=-1, achieved_ghz=2.0,
        notes="tile=4", node="c1", timestamp="t",
    )
    row.update(change)
    return row


def write_runs(path, rows, drop=()):
    names = [f.split()[0] for f in schemas.RUNS.split(", ") if f.split()[0] not in drop]
    lines = [",".join(names)] + [",".join(str(r[n]) for n in names) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def test_telemetry_headers_of_any_form(spark, tmp_path):
    (tmp_path / "own.csv").write_text("run_id,n_threads\n1-a,4\n")
    (tmp_path / "extra.csv").write_text("host,run_id,n_threads\nc1,2-a,8\nrun_id,3-a,8\n")
    (tmp_path / "quoted.csv").write_text('"run_id","n_threads"\n"4-a","2"\n')
    (tmp_path / "index.csv").write_text("\n,run_id,n_threads\n0,5-a,16\n")
    (tmp_path / "empty.csv").write_text("")
    names = ["own", "extra", "quoted", "index", "empty"]
    rows = files.read_telemetry(spark, [f"{tmp_path}/{n}.csv" for n in names]).select("run_id", "n_threads", "host").collect()
    assert sorted((r["run_id"], r["n_threads"], r["host"]) for r in rows) == [
        ("1-a", 4, None), ("2-a", 8, "c1"), ("3-a", 8, "run_id"), ("4-a", 2, None), ("5-a", 16, None)
    ]
    (tmp_path / "bare.csv").write_text("6-a,4\n7-a,4\n")
    with pytest.raises(ValueError, match="bare.csv"):
        files.read_telemetry(spark, [f"{tmp_path}/own.csv", f"{tmp_path}/bare.csv"])


def test_telemetry_union_and_load(spark, tmp_path):
    write_runs(tmp_path / "a.csv", [run_row(), run_row(repetition=0, warmup=1)])
    write_runs(tmp_path / "b.csv", [run_row(run_id="2-0-9-000001")], drop=("l3_tcm", "work_imbalance"))
    both = files.read_telemetry(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert both.count() == 3 and both.filter("l3_tcm IS NULL").count() == 1
    assert {r["__file"] for r in both.select("__file").distinct().collect()} == {"a.csv", "b.csv"}
    assert files.read_telemetry(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "work_imbalance").count() == 2
    assert files.load_runs(spark, f"{tmp_path}/a.csv").count() == 1
    assert files.schema_drift(spark, f"{tmp_path}/b.csv") == ["missing work_imbalance", "missing l3_tcm"]
    with pytest.raises(ValueError, match="missing"):
        files.load_runs(spark, f"{tmp_path}/b.csv")
    write_runs(tmp_path / "c.csv", [run_row(schedule="dynamic")])
    with pytest.raises(Exception, match="chunk_size_missing"):
        files.load_runs(spark, f"{tmp_path}/c.csv").collect()


def test_append_only_sink(spark, tmp_path):
    write_runs(tmp_path / "a.csv", [run_row()])
    runs = files.load_runs(spark, f"{tmp_path}/a.csv").selectExpr("* EXCEPT (notes)", "'x,y\nz' AS notes")
    out = str(tmp_path / "runs")
    sink.append_runs(runs, out)
    sink.append_runs(runs, out)
    rows = spark.read.parquet(out).collect()
    assert [r["notes"] for r in rows] == ["x;y z"] * 2
    bad = runs.selectExpr("* EXCEPT (wall_time_s)", "0.0D AS wall_time_s")
    with pytest.raises(Exception, match="wall_time_s"):
        sink.append_runs(bad, out)
    assert spark.read.parquet(out).count() == 2


def test_mixed_probe_file(spark, tmp_path):
    path = tmp_path / "probe.csv"
    run = "RUN,a,n1,8,close,default,1,/x,100,2.0,50.0,ff,2.1"
    thr = "THR,a,1,0,3,n1,10,1.0,10.0,0.9,0.1"
    path.write_text(f"junk\n{run}\n{thr}\nRUN,short\nNUMA,a,/x,0,12,100,24,0.5\n\n")
    out = files.read_probe(spark, str(path))
    assert {k: v.count() for k, v in out.items()} == {"RUN": 1, "THR": 1, "NUMA": 1}
    assert out["RUN"].first()["gb_s"] == 50.0 and out["THR"].first()["tid"] == 0


def test_sweep_json(spark, tmp_path):
    def doc(ceiling):
        return {"n_units": 10, "n_records": 100, "p_star": 56, "p_atom": 12.5,
                "sweep": [{"p": p, "regime": "II", "actions": ["a"], "ceiling": ceiling, "resolvable": True} for p in (16, 80)]}

    for name, c in (("W24", 0.01), ("W6", 0.01)):
        (tmp_path / f"sweep_{name}.json").write_text(json.dumps(doc(c), indent=1))
    sweeps = files.read_sweeps(spark, f"{tmp_path}/sweep_*.json")
    row = files.variant_table(sweeps).filter("variant = 'W6'").first()
    assert row["C16"] == pytest.approx(1.0) and row["C32"] is None
    assert [r["variant"] for r in files.unique_variants(sweeps).collect()] == ["W24"]


def test_artifacts_refuse_identifiers(spark, tmp_path):
    df = spark.range(2).withColumnRenamed("id", "stay_id")
    with pytest.raises(ValueError, match="stay_id"):
        sink.write_artifact(df, str(tmp_path / "x"))
    sink.write_artifact(spark.range(2), str(tmp_path / "y"))
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == 2
    rows = [r["row"] for r in sink.latex_rows(spark.sql("SELECT 'a' AS k, 1.234D AS v")).collect()]
    assert rows == [r"a & 1.23 \\"]


def test_record_sink_keeps_order(spark, tmp_path):
    records = spark.createDataFrame([(1, 0, 2.0, 1.0), (0, 1, 1.0, 5.0), (0, 0, 1.0, 4.0)], "row_index bigint, dense_id int, t double, value double")
    sink.write_records(records, str(tmp_path / "r"))
    assert files.footer_count(spark, str(tmp_path / "r")) == 3
    assert spark.read.parquet(str(tmp_path / "r")).schema["t"].dataType.simpleString() == "float"


def test_spark_forms_give_the_rows_of_their_relations(spark, sf_dir, monkeypatch):
    from talus.plans import adapters

    assert set(adapters.SPARK_FORMS) == {"chartevents", "labevents"}
    for name in list(adapters.SPARK_FORMS):
        own = adapters.relation(spark, sf_dir, name)
        with monkeypatch.context() as m:
            m.delitem(adapters.SPARK_FORMS, name)
            plain = adapters.relation(spark, sf_dir, name)
        assert own.schema.simpleString() == plain.schema.simpleString()
        assert own.exceptAll(plain).count() == 0 and plain.exceptAll(own).count() == 0
