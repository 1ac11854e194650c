"""Chunked paths must equal the plain window, also when one run holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequence as Q
from tidemark.operators.timejoin import asof


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for run, n in (("hot", 400), ("b", 40), ("c", 1)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.2, 1.0, 1.0, 30.0])
            rows.append((run, i, round(t, 3), rng.choice([None, float(rng.randint(-9, 9))])))
    return spark.createDataFrame(rows, "run_id string, i int, t double, value double").repartition(5)


def same(a, b, cols):
    key = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert key(a) == key(b)


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_neighbours(skewed, width):
    plain = Q.neighbours(skewed, ["run_id"], ["t", "i"], ["i", "value"], None, lead=True)
    cut = Q.neighbours(skewed, ["run_id"], ["t", "i"], ["i", "value"], width, lead=True)
    same(plain, cut, ["run_id", "i", "prev", "next"])


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(skewed, reverse, exclusive):
    specs = {"s": ("sum", "value"), "n": ("count", "value"), "hi": ("max", "value"), "lo": ("min", "value"), "last_": ("last", "value")}
    plain = Q.running(skewed, ["run_id"], ["t", "i"], specs, None, reverse, exclusive)
    cut = Q.running(skewed, ["run_id"], ["t", "i"], specs, 3.0, reverse, exclusive)
    fill = lambda df: df.withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("n", F.coalesce("n", F.lit(0)))
    same(fill(plain), fill(cut), ["run_id", "i", *specs])


def test_islands_and_ordinal(skewed):
    starts = lambda p: F.col("t") - p["t"] > 5
    same(
        Q.islands(skewed, ["run_id"], ["t", "i"], starts, ["t"], None),
        Q.islands(skewed, ["run_id"], ["t", "i"], starts, ["t"], 2.0), ["run_id", "i", "island"],
    )
    placed = Q.ordinal(skewed, ["run_id"], ["t", "i"], "pos", 2.0)
    assert placed.where("pos <> i").count() == 0


def test_chunk_width_only_for_large_runs(skewed):
    assert Q.chunk_width(skewed, ["run_id"], "t", target_rows=1000) is None
    assert Q.chunk_width(skewed, ["run_id"], "t", target_rows=50) > 0


@pytest.mark.parametrize("burst", ["one second", "one time"])
def test_chunks_of_a_burst_stay_near_the_target(spark, burst):
    span = 0.0 if burst == "one time" else 1.0
    rows = spark.range(20_000).select(
        F.lit("hot").alias("run_id"), F.col("id").alias("row_key"),
        F.when(F.col("id") % 25 == 0, F.col("id") * 100.0 * span).otherwise(F.rand(1) * span).alias("t"),
    )
    chunks = Q.chunk_width(rows, ["run_id"], "t", target_rows=1000)
    assert chunks == 20
    sizes = Q._chunked(rows, ["run_id"], ["t"], chunks).groupBy("run_id", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < 2000
    got = Q.ordinal(rows, ["run_id"], ["t", "row_key"], "pos", chunks)
    same(got, Q.ordinal(rows, ["run_id"], ["t", "row_key"], "pos"), ["row_key", "pos"])


@pytest.mark.parametrize("reverse", [False, True])
def test_row_chunks_equal_the_plain_window(skewed, reverse):
    chunks = Q.chunk_width(skewed, ["run_id"], "t", target_rows=50)
    specs = {"n": ("count", "value"), "hi": ("max", "value"), "last_": ("last", "value")}
    plain = Q.running(skewed, ["run_id"], ["t", "i"], specs, None, reverse)
    same(plain, Q.running(skewed, ["run_id"], ["t", "i"], specs, chunks, reverse), ["run_id", "i", *specs])
    both = [Q.neighbours(skewed, ["run_id"], ["t", "i"], ["i"], w, lead=True) for w in (None, chunks)]
    same(*both, ["run_id", "i", "prev", "next"])


def test_asof_matches_brute_force(spark, skewed):
    table = skewed.where("i % 3 = 0").select("run_id", "t", "i")
    probes = skewed.select("run_id", (F.col("t") + (F.col("i") % 2) * 0.1).alias("p"), F.col("i").alias("probe"))
    got = asof(probes, table, ["run_id"], "p", "t", ["t", "i"], 4.0).collect()
    rows = {}
    for r in table.collect():
        rows.setdefault(r.run_id, []).append((r.t, r.i))
    for g in got:
        have = rows.get(g.run_id, [])
        lo = max((x for x in have if x[0] <= g.p), default=None)
        hi = min((x for x in have if x[0] >= g.p), default=None)
        assert (lo is None) == (g.lo is None) and (lo is None or g.lo.t == lo[0])
        assert (hi is None) == (g.hi is None) and (hi is None or g.hi.t == hi[0])
