"""Successive fronts against peeling, over one block and over many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pareto as PF


def peeled(points):
    left, front, out = set(range(len(points))), 0, {}
    while left:
        ids = sorted(left)
        p = points[ids]
        beaten = [(np.all(p >= x, axis=1) & np.any(p > x, axis=1)).any() for x in p]
        now = [i for i, b in zip(ids, beaten, strict=True) if not b]
        out |= dict.fromkeys(now, front)
        left -= set(now)
        front += 1
    return out


def frame(spark, points):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"c{k} double" for k in range(points.shape[1]))).repartition(5)


@pytest.mark.parametrize("dims, n, block", [(2, 600, 20_000), (2, 600, 90), (3, 500, 120), (1, 300, 70), (3, 400, 20_000)])
def test_fronts_match_peeling(spark, dims, n, block):
    points = np.random.default_rng(dims * n + block).integers(0, 25, size=(n, dims)).astype(float)
    got = PF.successive_fronts(frame(spark, points), "id", [f"c{k}" for k in range(dims)], block_rows=block)
    assert {r.id: r.front for r in got.collect()} == peeled(points)


def test_two_hundred_fronts_need_no_job_per_front(spark):
    rng = np.random.default_rng(0)
    chain = np.arange(200)[:, None] + rng.random((200, 2)) * 0.01
    points = np.concatenate((chain, rng.random((800, 2)) * 200))
    group = "fronts"
    spark.sparkContext.setJobGroup(group, "")
    got = {r.id: r.front for r in PF.successive_fronts(frame(spark, points), "id", ["c0", "c1"]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == peeled(points) and max(got.values()) >= 199 and jobs < 20


@pytest.mark.parametrize("block", [20_000, 60])
def test_first_fronts_only(spark, block):
    points = np.random.default_rng(9).integers(0, 40, size=(400, 2)).astype(float)
    want = peeled(points)
    got = PF.successive_fronts(frame(spark, points), "id", ["c0", "c1"], max_fronts=3, block_rows=block)
    assert {r.id: r.front for r in got.collect()} == {i: f for i, f in want.items() if f < 3}
    some = PF.successive_fronts(frame(spark, points), "id", ["c0", "c1"], want=17, block_rows=block)
    best = PF.take_by_front(some, "id", [F.desc("c0")], 17).collect()
    order = sorted(want, key=lambda i: (want[i], -points[i, 0], i))[:17]
    assert [r.id for r in best] == order and [r.front for r in best] == [want[i] for i in order]


def test_sums_that_tie_by_rounding_and_nulls(spark):
    rows = [(0, 1e16, 1.0), (1, 1e16, 0.5), (2, 1e16, 0.0), (3, None, 1.0), (4, 1e16, 1.0)]
    got = PF.successive_fronts(spark.createDataFrame(rows, "id int, c0 double, c1 double"), "id", ["c0", "c1"])
    assert {r.id: r.front for r in got.collect()} == {0: 0, 4: 0, 1: 1, 2: 2}
    assert PF.successive_fronts(spark.createDataFrame([], "id int, c0 double"), "id", ["c0"]).count() == 0
