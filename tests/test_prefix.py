import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators.prefix import dense_index, dense_index_by_hash, dense_index_by_id, indexed_counts, running_sums
from talus.operators.quantiles import grouped_quantiles, medians
from talus.operators.records import expand, offsets, shape_trimmed, size_matched


def test_dense_index_by_id_with_gaps(spark):
    ids = [5, 70_000, 70_001, 200_000, 3, 1_000_000]
    rows = dense_index_by_id(spark.createDataFrame([(i,) for i in ids], "k bigint"), "k").orderBy("idx").collect()
    assert [r["k"] for r in rows] == sorted(ids)
    assert [r["idx"] for r in rows] == list(range(len(ids)))


def test_dense_index_with_heavy_ties(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"))
    rows = dense_index(df, [F.desc("v"), F.asc("id")]).orderBy("idx").collect()
    expected = sorted(((r["id"], r["v"]) for r in rows), key=lambda x: (-x[1], x[0]))
    assert [(r["id"], r["v"]) for r in rows] == expected
    assert [r["idx"] for r in rows] == list(range(5000))


def test_hash_permutation_is_dense_and_reproducible(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = {r["k"]: r["row_index"] for r in dense_index_by_hash(df, "k", 1).collect()}
    b = {r["k"]: r["row_index"] for r in dense_index_by_hash(df.repartition(3), "k", 1).collect()}
    assert a == b and sorted(a.values()) == list(range(3000))
    assert [a[k] for k in range(3000)] != list(range(3000))


def test_running_sums_any_order(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(x), int(n)) for i, (x, n) in enumerate(zip(rng.random(800).round(2), rng.integers(0, 9, 800)))]
    df = spark.createDataFrame(data, "id int, x double, n bigint")
    rows = running_sums(df, [F.col("x"), F.col("id")], {"cs": F.col("n")}).orderBy("x", "id").collect()
    assert [r["cs"] for r in rows] == np.cumsum([n for _, _, n in sorted(data, key=lambda r: (r[1], r[0]))]).tolist()


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": np.concatenate([rng.normal(size=900), [1.5] * 300]), "small": rng.normal(size=7), None: np.array([4.0, 8.0])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("small", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"a": ("v", 0.001), "b": ("v", 0.5), "c": ("v", 0.999)}
    rows = {r["g"]: r for r in grouped_quantiles(df, ["g"], wanted, [F.count("v").alias("n")]).collect()}
    for g, vs in groups.items():
        assert rows[g]["n"] == len(vs)
        for name, (_, q) in wanted.items():
            assert rows[g][name] == pytest.approx(np.quantile(vs, q))
    assert rows["empty"]["b"] is None


def test_quantiles_of_infinities(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("inf")), (1, float("inf")), (2, 1.0), (2, float("inf"))], "k int, v double")
    rows = {r["k"]: r["q"] for r in grouped_quantiles(df, ["k"], {"q": ("v", 0.5)}).collect()}
    assert rows == {1: float("inf"), 2: float("inf")}


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, None), (2, 7.0, 9.0)], "k int, a double, b double")
    rows = {r["k"]: (r["a"], r["b"]) for r in medians(df, ["k"], {"a": "a", "b": "b"}).collect()}
    assert rows == {1: (2.0, 5.0), 2: (7.0, 9.0)}


def test_offsets_expand_and_families(spark):
    sizes = [3, 0, 5, 1, 0, 9]
    units = spark.createDataFrame(list(enumerate(sizes)), "idx bigint, n bigint")
    spans = offsets(units)
    assert [(r["start"], r["stop"]) for r in spans.orderBy("idx").collect()] == [(0, 3), (3, 3), (3, 8), (8, 9), (9, 9), (9, 18)]
    for piece in (2, 1 << 20):
        got = sorted((r["pos"], r["idx"]) for r in expand(spans, piece).collect())
        assert got == list(enumerate(np.repeat(np.arange(6), sizes).tolist()))
    assert [r["idx"] for r in size_matched(units, 4).orderBy("idx").collect()] == [0, 1, 2]
    assert size_matched(units, 8).count() == 3
    assert shape_trimmed(units, 20).agg(F.max("n")).first()[0] == 5
    assert shape_trimmed(units, 0).count() == 6


def test_sparse_ids_make_no_block_each(spark):
    ids = [i * 1_000_003 for i in range(500)]
    df = spark.createDataFrame([(i, 1 + i % 3) for i in ids], "k bigint, n bigint")
    rows = dense_index_by_id(df, "k", width=4).orderBy("idx").collect()
    assert [r["k"] for r in rows] == ids
    sums = indexed_counts(df, "k").orderBy("idx").collect()
    assert [r["cs"] for r in sums] == np.cumsum([1 + i % 3 for i in ids]).tolist()
