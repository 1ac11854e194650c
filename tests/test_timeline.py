import math

from tidemark.operators.panel import frame_range, timeline_coverage


def test_coverage_of_tiled_gapped_and_empty_runs(spark):
    rows = [("a", 2.0, 2.0, True), ("a", 4.0, 2.0, True), ("a", 4.0, 2.0, False), ("b", 0.0, 1.5, True), ("b", 4.0, 1.5, True), ("b", 2.0, None, True), ("c", 0.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "run_id string, start_t double, duration double, kept boolean")
    for width in (None, 3.0):
        got = {x.run_id: tuple(x)[1:] for x in timeline_coverage(frame, 2.0, 1.0, width=width).select(
            "run_id", "n_kept", "n_total", "first_start", "last_end", "covered_seconds", "contiguous", "notes").collect()}
        assert got == {
            "a": (2, 3, 2.0, 6.0, 4.0, True, "tiled"), "b": (2, 3, 0.0, 5.5, 3.0, False, "before_start"), "c": (0, 1, None, None, None, True, ""),
        }


def test_frame_range_skips_what_is_not_finite(spark):
    rows = [("a", 0, 1.0), ("a", 0, -3.0), ("a", 0, math.nan), ("a", 0, math.inf), ("a", 1, None), ("a", 1, math.nan)]
    got = sorted(map(tuple, frame_range(spark.createDataFrame(rows, "run_id string, row_idx int, value double")).collect()))
    assert got == [("a", 0, -3.0, 1.0, -1.0, 2), ("a", 1, 0.0, 0.0, 0.0, 0)]
