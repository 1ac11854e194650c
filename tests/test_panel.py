import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare as C
from tidemark.operators import panel as P


def panel(spark, runs):
    rows = [
        (run, i, float(i), u, float(v)) for run, matrix in runs.items() for i, row in enumerate(matrix) for u, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "run_id string, row_idx int, t double, unit_id int, value double")


def units(spark, regions, excluded=()):
    rows = [(u, None if r is None or u in excluded else r, 0, "left" if u < 2 else "right", u in excluded) for u, r in enumerate(regions)]
    return spark.createDataFrame(rows, "unit_id int, region_id int, network_id int, hemisphere string, excluded boolean")


def test_region_means_and_non_finite_cells(spark):
    um = units(spark, [0, 0, 1, 1])
    got = P.region_means(panel(spark, {"a": [[1.0, 2, 3, 4], [2, 4, 6, 8]]}), um).collect()
    assert sorted((r.row_idx, r.region_id, r.value) for r in got) == [(0, 0, 1.5), (0, 1, 3.5), (1, 0, 3.0), (1, 1, 7.0)]
    odd = P.region_means(panel(spark, {"a": [[1.0, math.nan, 100, 4]]}), units(spark, [0, 0, None, 1])).collect()
    assert sorted((r.region_id, r.value) for r in odd) == [(0, 1.0), (1, 4.0)]


def test_global_and_hemisphere_metrics(spark):
    p, um = panel(spark, {"a": [[1.0, 3, 5, 7], [2, 4, 6, 8]]}), units(spark, [0, 0, 1, 1])
    g = {r.row_idx: r for r in P.global_metrics(p, um).collect()}
    assert g[0]["mean"] == 4 and g[1]["mean"] == 5 and abs(g[0].l2_magnitude - math.sqrt(84)) < 1e-12 and g[1].median == 5
    h = {r.row_idx: r for r in P.hemisphere_means(p, um).collect()}
    assert (h[0].left_mean, h[0].right_mean, h[1].left_minus_right) == (2, 6, -4)
    masked = P.global_metrics(panel(spark, {"a": [[1.0, 1000, 3, 2000]]}), units(spark, [0, 0, 1, 1], (1, 3))).first()
    assert masked["mean"] == 2


def test_change_is_zero_first_and_skips_missing_rows(spark):
    p = panel(spark, {"a": [[1.0, 1], [4, 5], [4, 5], [7, 9]]}).where("NOT (row_idx = 2 AND unit_id = 1)")
    got = {r.row_idx: r.change_magnitude for r in P.change_magnitude(p).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 0.0, 3: 3.0}


def test_concentration_bounds(spark):
    p, um = panel(spark, {"a": [[1.0, 1, 1, 1], [5, 0, 0, 0], [0, 0, 0, 0]]}), units(spark, [0, 0, 1, 1])
    got = {r.row_idx: round(r.concentration, 9) for r in P.spatial_concentration(p, um).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 0.0}


def test_swapping_sides_negates_and_identical_runs_have_no_events(spark):
    base = [[1.0, 2, 3, 4], [2, 4, 6, 8]]
    other = [[2.0, 1, 5, 2], [4, 2, 10, 4]]
    p = panel(spark, {"a": base, "b": other, "c": base})
    rows = p.select("run_id", "row_idx", "t").distinct()

    def delta(ref, cand):
        pairs = spark.createDataFrame([(ref, cand)], "ref_run string, cand_run string")
        return C.difference(C.align_rows(rows, pairs, 0.0, 1.0), p)

    there = {(r.ref_row, r.unit_id): r.delta for r in delta("a", "b").collect()}
    back = {(r.ref_row, r.unit_id): r.delta for r in delta("b", "a").collect()}
    assert there == {k: -v for k, v in back.items()}
    assert C.rank_divergence(C.row_differences(delta("a", "c"))).count() == 0


def test_shortlist_gives_the_same_events_as_the_full_greedy(spark):
    values = [(i * 7919) % 101 / 10 for i in range(300)]
    rows = spark.createDataFrame([("a", "b", i, i, float(i), v, v) for i, v in enumerate(values)], "ref_run string, cand_run string, ref_row int, cand_row int, t double, l2 double, rms double")
    got = [r.aligned_index for r in C.rank_divergence(rows, 2, 12).orderBy("event_rank").collect()]
    want: list[int] = []
    for i in sorted(range(300), key=lambda i: (-values[i], i)):
        if values[i] > 0 and all(abs(i - w) > 4 for w in want):
            want.append(i)
        if len(want) == 12:
            break
    assert got == want


def test_suppression_matches_greedy(spark):
    values = [(i * 31) % 17 + 0.5 for i in range(120)]
    df = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(values)], "run_id string, row_idx int, t double, value double")
    peaks = P.local_peaks(df, 0.0)
    ids = {r.row_idx: r.value for r in peaks.collect()}
    want: list[int] = []
    for i in sorted(ids, key=lambda i: (-ids[i], i)):
        if all(abs(i - w) >= 5 for w in want):
            want.append(i)
    assert sorted(r.row_idx for r in P.suppress_close(peaks, 5).collect()) == sorted(want)
    assert sorted(r.row_idx for r in P.suppress_close(peaks, 5, span=7).collect()) == sorted(want)


def test_constant_series_has_no_correlation(spark):
    s = spark.createDataFrame([("a", i, k, float(i) if k else 3.0) for i in range(5) for k in (0, 1)], "run_id string, row_idx int, region_id int, value double")
    got = {(r.region_id_a, r.region_id_b): r.correlation for r in P.correlation_matrix(s, "region_id").collect()}
    assert got[(0, 1)] is None and got[(0, 0)] is None and abs(got[(1, 1)] - 1) < 1e-12
    assert s.where(F.col("region_id") == 1).count() == 5


def brute_suppression(rows, distance):
    kept = np.zeros(max(r for r, _ in rows) + 1, dtype=bool)
    for row, _ in sorted(rows, key=lambda x: (-x[1], x[0])):
        if not kept[max(0, row - distance + 1) : row + distance].any():
            kept[row] = True
    return set(np.flatnonzero(kept).tolist())


@pytest.mark.parametrize("shape", ["random", "rising", "ties", "waves"])
@pytest.mark.parametrize("span", [9, 64])
def test_suppression_over_span_borders(spark, shape, span):
    rng = random.Random(3)
    value = {"random": lambda i: rng.random(), "rising": lambda i: float(i), "ties": lambda i: float(i % 3), "waves": lambda i: math.sin(i / 9.0) + i / 1e6}[shape]
    rows = [(i, value(i)) for i in range(400) if rng.random() < 0.8]
    df = spark.createDataFrame([("a", i, v) for i, v in rows] + [("b", i, -v) for i, v in rows], "run_id string, row_idx int, value double")
    got = P.suppress_close(df, 6, span=span).collect()
    for run, sign in (("a", 1), ("b", -1)):
        assert {r.row_idx for r in got if r.run_id == run} == brute_suppression([(i, sign * v) for i, v in rows], 6)


def test_suppression_of_a_chain_of_a_million_peaks(spark):
    n, distance = 1_000_000, 10
    peaks = spark.range(n).select(F.lit("a").alias("run_id"), F.col("id").cast("int").alias("row_idx"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("value"))
    rows = [(r.row_idx, r.value) for r in peaks.toPandas().itertuples()]
    got = {r[0] for r in P.suppress_close(peaks, distance).select("row_idx").toPandas().itertuples(index=False)}
    assert got == brute_suppression(rows, distance)
