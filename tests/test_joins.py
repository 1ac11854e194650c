import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timejoin as J


def line(spark, name, times):
    return spark.createDataFrame([("r", i, float(t)) for i, t in enumerate(times)], f"run_id string, {name}_row int, {name}_t double")


def test_exact_alignment(spark):
    out = J.tolerance_join(line(spark, "a", [0, 1, 7, 9]), line(spark, "b", [1, 4, 7]), ["run_id"], "a_t", "b_t", 0.0, 1.0)
    assert sorted((r.a_row, r.b_row, r.t, r.ambiguous) for r in out.collect()) == [(1, 0, 1.0, False), (2, 2, 7.0, False)]


@pytest.mark.parametrize("a,b", [([1.0, 1.1], [1.05]), ([1.05], [1.0, 1.1])])
def test_ambiguity_is_flagged_and_strict_mode_fails(spark, a, b):
    out = J.tolerance_join(line(spark, "a", a), line(spark, "b", b), ["run_id"], "a_t", "b_t", 0.2)
    assert all(r.ambiguous for r in out.collect()) and out.count() == 2
    with pytest.raises(Exception, match="ambiguous"):
        J.strict_pairs(out).collect()


@pytest.mark.parametrize("width", ["flat", "levels"])
def test_overlap_join_has_every_pair_once(spark, width):
    rng = random.Random(5)

    def spans(n, longest):
        return [(i % 2, i, s := rng.uniform(0, 100), s + rng.uniform(0.1, longest)) for i in range(n)]

    a, b = spans(60, 40), spans(60, 3) + [(0, 60, -500.0, 4000.0), (1, 61, 20.0, 900.0)]
    left = spark.createDataFrame(a, "k int, a int, s1 double, e1 double")
    right = spark.createDataFrame(b, "k int, b int, s2 double, e2 double")
    w = 2.5
    if width == "levels":
        w = J.bucket_width(right.where("b < 60"), "s2", "e2")
        w.levels = J.bucket_width(right, "s2", "e2").levels + 2
    got = sorted((r.a, r.b) for r in J.overlap_join(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), w).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


def test_interpolation_rules(spark):
    table = spark.createDataFrame([("r", 0.0, 1.0), ("r", 2.0, 3.0), ("r", 10.0, 7.0), ("r", 11.0, None)], "run_id string, t double, v double")
    targets = spark.createDataFrame([("r", x) for x in (-1.0, 0.0, 1.0, 6.0, 10.5, 12.0)], "run_id string, p double")
    rows = {r.p: r.interpolated for r in J.interpolate(targets, table, ["run_id"], "p", "t", "v", 5.0).collect()}
    assert rows == {-1.0: None, 0.0: 1.0, 1.0: 2.0, 6.0: None, 10.5: None, 12.0: None}
    held = {r.p: r.interpolated for r in J.interpolate(targets, table, ["run_id"], "p", "t", "v", hold_ends=True).collect()}
    assert held[-1.0] == 1.0 and held[6.0] == 5.0


def test_half_open_stab(spark):
    spans = spark.createDataFrame([("r", 0.0, 5.0, "A"), ("r", 5.0, 10.0, "B")], "run_id string, s double, e double, name string")
    points = spark.createDataFrame([("r", 5.0), ("r", 4.999)], "run_id string, t double")
    got = {r.t: r.name for r in J.stab_join(points, spans, ["run_id"], "t", ("s", "e"), 2.0).collect()}
    assert got == {5.0: "B", 4.999: "A"}


def test_nearest_tie_goes_to_the_earlier_row(spark):
    table = line(spark, "b", [0, 2])
    probe = spark.createDataFrame([("r", 1.0), ("r", 1.2)], "run_id string, p double")
    got = {r.p: r.hit.b_row for r in J.nearest(probe, table, ["run_id"], "p", "b_t", ["b_row"]).collect()}
    assert got == {1.0: 0, 1.2: 1}


def test_range_joins_do_not_plan_nested_loops(spark):
    a = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("s1"), (F.col("id") + 2.0).alias("e1"))
    b = a.select("k", F.col("s1").alias("s2"), F.col("e1").alias("e2"))
    for df in (
        J.overlap_join(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), 4.0),
        J.stab_join(a, b, ["k"], "s1", ("s2", "e2"), 4.0),
        J.tolerance_join(a.select("k", "s1"), b.select("k", "s2"), ["k"], "s1", "s2", 0.5),
        J.asof(a, b, ["k"], "s1", "s2", ["s2"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
