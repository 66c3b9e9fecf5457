import pytest

from talus.operators.skew import copies, heavy_keys, lag_within, likely_members, salted_join


@pytest.mark.parametrize("limit", [0, 10**6])
def test_salted_join_keeps_every_row(spark, limit):
    big = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k")
    small = spark.range(49).selectExpr("id AS k", "id * 10 AS v")  # key 49 has no partner
    got = sorted((r["id"], r["k"], r["v"]) for r in salted_join(big, small, "k", ["id"], broadcast_bytes=limit).collect())
    want = sorted((r["id"], r["k"], r["v"]) for r in big.join(small, "k").collect())
    assert got == want


def test_hot_key_is_spread_before_an_aggregation(spark):
    big = spark.range(1000).selectExpr("id", "id % 2 AS k")
    small = spark.range(5).selectExpr("id AS k", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = salted_join(big, small, "k", ["id"], broadcast_bytes=0).groupBy("k").count()
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # join by (k, salt), partial counts, and a second exchange by k alone
    assert text.count("Exchange hashpartitioning") == 3 and "partial_count" in text


def test_only_heavy_keys_are_copied(spark):
    """One key with 90 % of the rows: it is spread over the tasks, the other 999 keys are copied once."""
    big = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 7 WHEN id % 10 = 9 AND id % 50 = 9 THEN NULL ELSE id % 1000 END AS k")
    small = spark.range(1000).selectExpr("id AS k", "id * 10 AS v")
    heavy = heavy_keys(big, "k", 8)
    (row,) = heavy.collect()
    assert row["k"] == 7 and 14 <= row["_salts"] <= 16
    assert copies(small, heavy, "k").count() == 999 + row["_salts"]
    got = sorted(tuple(r) for r in salted_join(big, small, "k", ["id"], broadcast_bytes=0).select("id", "k", "v").collect())
    assert got == sorted(tuple(r) for r in big.join(small, "k").select("id", "k", "v").collect())
    assert heavy_keys(big.where("id < 0"), "k", 8).count() == 0


def test_even_keys_are_not_copied(spark):
    big = spark.range(5000).selectExpr("id", "id % 500 AS k")
    assert heavy_keys(big, "k", 8).count() == 0


def test_lag_with_null_keys(spark):
    rows = [("a", t, t * t % 7) for t in (0, 2, 5, 9)] + [("b", t, t) for t in range(300)] + [(None, 1, 10), (None, 2, 20)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    got = {(r["k"], r["t"]): r["p"] for r in lag_within(df, "k", "t", "v", "p").collect()}
    by = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        assert got[(k, t)] == by.get(k)
        by[k] = v


def test_likely_members_keep_every_member(spark):
    """Keys of another width, null and repeated keys; most other rows go, none does where the members are few."""
    big = spark.range(40_000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN NULL ELSE CAST(id % 20000 - 500 AS INT) END AS k").repartition(4)
    members = spark.range(0, 20_000, 3).selectExpr("id - 500 AS m").unionByName(spark.range(50).selectExpr("id AS m"))
    kept = likely_members(big, "k", members, few=0)
    assert kept.columns == big.columns
    wanted = big.join(members.distinct(), big["k"] == members["m"], "left_semi")
    assert wanted.exceptAll(kept).count() == 0 and kept.exceptAll(big).count() == 0
    others = big.count() - wanted.count()
    assert kept.count() - wanted.count() < others / 4
    assert likely_members(big, "k", members) is big
    assert likely_members(big, "k", members.where("m < -9999"), few=-1).count() == 0
