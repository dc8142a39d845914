"""Fragment and replicate, and figures per series (problem 5)."""

import random

from pyspark.sql import functions as F

from sampleloom.operators import series, skew

SAMPLES = "sample_index long, series_id string, in_holdout boolean, mean_abs_z float"


def test_plan_packs_and_splits(spark):
    df = spark.createDataFrame([("hot",)] * 9000 + [(f"k{k % 400}",) for k in range(3000)], "key string")
    plan = skew.plan_load(df, ["key"], tasks=6, shard_rows=1000)
    assert len(plan.heavy) == 1 and len(next(iter(plan.heavy.values()))) == 9
    rows, shard, task = skew.fragment(df.withColumn("i", F.monotonically_increasing_id()), plan, ["key"], ["i"])
    loads = [r["count"] for r in rows.groupBy(task).count().collect()]
    assert len(loads) == 6 and max(loads) <= 1.5 * 12000 / 6
    assert rows.where("key = 'hot'").select(shard).distinct().count() == 9


def test_join_equals_a_plain_join(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([("a" if rng.random() < 0.7 else rng.choice(["b", "c", None, "z"]), k, k) for k in range(5000)], "key string, _shard long, x long")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("q", 5)], "key string, y long")
    for how in ("inner", "left", "left_semi"):
        plan = skew.plan_load(left, ["key"], tasks=4, shard_rows=300)
        assert plan.heavy
        got = skew.fragment_replicate_join(left, right, "key", how, plan)
        want = left.join(right, "key", how)
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_join_of_empty_sides(spark):
    left, right = spark.createDataFrame([], "key string, x long"), spark.createDataFrame([("a", 1)], "key string, y long")
    assert skew.fragment_replicate_join(left, right, "key").count() == 0
    assert skew.fragment_replicate_join(right.withColumnRenamed("y", "x"), left.withColumnRenamed("x", "y"), "key", "left").count() == 1


def test_series_figures(spark):
    rows = [(k, " gse1 " if k % 2 else "GSE1", k % 4 == 0, 1.0) for k in range(4000)] + [(k, "GSE1; GSE2", None, None) for k in range(4000, 4010)] + [(1, "gse1", False, 1.0), (5000, None, True, 1.0), (None, "GSE1", True, 1.0), (5001, "", True, 1.0), (5002, "GSE3", True, 2.0)]
    df = spark.createDataFrame(rows, SAMPLES).selectExpr("*", "1 as held", "2 as _task")
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(3000)] + [(0, True), (4000, None)], "sample_index long, is_cvd_disease boolean")
    plan = skew.plan_load(series.series_rows(df), ["series_id"], tasks=4, shard_rows=300)
    got = {r["series_id"]: tuple(r)[1:] for r in series.series_figures(df, labels, plan).collect()}
    assert got == {"GSE1": (4010, 1000, 1000, 2000, 1010), "GSE2": (10, 0, 0, 0, 10), "GSE3": (1, 1, 0, 0, 1)}
    assert [r["series_id"] for r in series.large_series(df).collect()] == ["GSE1"]
    assert series.large_series(df.limit(0)).count() == 0
    above = {(r["series_id"], r["sample_index"]): r["above_series"] for r in series.sample_against_series(df).collect()}
    assert above["GSE3", 5002] == 0 and above["GSE2", 4000] is None


def test_every_task_of_a_large_plan_works(spark):
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as key")
    plan = skew.plan_load(df, ["key"], tasks=2000)
    assert set(plan.light) | {t for ts in plan.heavy.values() for t in ts} == set(range(2000))
    rows, shard, task = skew.fragment(df.withColumn("i", F.monotonically_increasing_id()), plan, ["key"], ["i"])
    loads = [r["count"] for r in rows.groupBy(task).count().collect()]
    assert len(loads) > 1900 and sum(loads) == 60_000


def test_no_shard_is_larger_than_wanted(spark):
    df = spark.range(40_000).selectExpr("concat('k', id % 40) as key", "id")  # each key is heavy
    plan = skew.plan_load(df, ["key"], tasks=8, shard_rows=100)
    assert len(plan.heavy) == 40 and all(len(t) == 10 for t in plan.heavy.values())


def test_only_what_is_small_in_bytes_is_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" * 5000), (2, None)], "a int, b string")
    assert skew.broadcastable(df)
    monkeypatch.setattr(skew, "MAX_BROADCAST", 1000)
    assert not skew.broadcastable(df) and skew.broadcastable(df.limit(0))


def test_join_with_a_dimension(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a", k) for k in range(3000)] + [(2, "b", 1), (None, "a", 2)], "b int, c string, x long")
    small = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "z", 9), (None, "a", 5)], "b int, c string, y int")
    want = left.join(small, ["b", "c"])
    for most in (100_000, 1):
        monkeypatch.setattr(skew, "MAX_HEAVY", most)
        got = skew.join_dimension(left, small, ["b", "c"]).select(*want.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
