"""Gate, linear alignment and whole comparisons on hand-made runs."""

import numpy as np
import pytest
from test_panel import panel, units

from tidemark.operators import comparison as V

PAIRS = "ref_run string, cand_run string"


def timeline(spark, **runs):
    rows = [(run, i, float(t)) for run, times in runs.items() for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "run_id string, row_idx int, t double")


def manifests(spark, **changes):
    base = dict(stimulus_sha256="s", model_fingerprint="m", vertex_count=4, hemisphere_ranges={"left": [0, 2], "right": [2, 4]}, atlas_version=None)
    rows = [{**base, "stimulus_sha256": run, **change, "run_id": run} for run, change in changes.items()]
    kind = "run_id string, stimulus_sha256 string, model_fingerprint string, vertex_count int, hemisphere_ranges map<string,array<int>>, atlas_version string"
    names = [c.split()[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kind)


def test_linear_alignment_never_extrapolates(spark):
    rows = timeline(spark, a=[-1, 0, 1, 2, 3], b=[0, 2])
    pairs = spark.createDataFrame([("a", "b")], PAIRS)
    got = sorted(V.align_linear(rows, pairs, 1e-6, 2.0).collect(), key=lambda r: r.t)
    assert [(r.t, r.observed, r.left_row, r.right_row, r.weight) for r in got] == [(0, True, 0, 0, 0), (1, False, 0, 1, 0.5), (2, True, 1, 1, 0)]
    assert {r.problem for r in got} == {None}
    cells = panel(spark, {"b": [[0.0], [4.0]], "a": [[9.0]] * 5}).withColumnRenamed("t", "_t")
    found = {r.t: r.cand_value for r in V.difference(V.align_linear(rows, pairs, 1e-6, 2.0), cells).collect()}
    assert found == {0.0: 0.0, 1.0: 2.0, 2.0: 4.0}


def test_brackets_weights_and_coverage(spark):
    rows = timeline(spark, a=[0.5, 1.5], b=[0, 2])
    aligned = V.align(rows, spark.createDataFrame([("a", "b")], PAIRS), V.LINEAR, 1e-6, 2.0)
    assert sorted((r.left_row, r.right_row, r.weight) for r in aligned.collect()) == [(0, 1, 0.25), (0, 1, 0.75)]
    c = V.coverage(aligned, rows).first()
    assert (c.interpolated_samples, c.candidate_fraction, c.reference_fraction) == (2, 1.0, 1.0)


@pytest.mark.parametrize("a, b, problem", [([0.0], [-0.1, 0.1], "ambiguous"), ([5.0], [0.0, 20.0], "gap")])
def test_problems_are_named_and_strict_fails(spark, a, b, problem):
    aligned = V.align_linear(timeline(spark, a=a, b=b), spark.createDataFrame([("a", "b")], PAIRS), 0.2, 10.0)
    assert [r.problem for r in aligned.collect()] == [problem]
    with pytest.raises(Exception, match=problem):
        V.strict(aligned).collect()


def test_missing_ends_of_a_bracket_stay_missing(spark):
    rows = timeline(spark, a=[1], b=[0, 2])
    aligned = V.align_linear(rows, spark.createDataFrame([("a", "b")], PAIRS), 0.0, 5.0)
    cells = panel(spark, {"a": [[1.0, 1.0]], "b": [[1.0, 1.0], [3.0, float("nan")]]})
    got = {r.unit_id: r.delta for r in V.difference(aligned, cells.drop("t")).collect()}
    assert got == {0: 1.0, 1: None}


def test_linear_alignment_matches_interp_on_random_times(spark):
    rng = np.random.default_rng(4)
    a, b, c = (np.sort(rng.choice(4000, 120, replace=False)) / 7.0 for _ in range(3))
    values = {k: rng.normal(size=(120, 3)) for k in "abc"}
    rows = timeline(spark, a=a, b=b, c=c)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], PAIRS)
    cells = panel(spark, {k: v.tolist() for k, v in values.items()}).drop("t")
    times = {"a": a, "b": b, "c": c}
    got = V.difference(V.align_linear(rows, pairs, 1e-9, 1e9).where("problem IS NULL"), cells).collect()
    for ref, cand in ("ab", "ac", "bc"):
        inside = [i for i, t in enumerate(times[ref]) if times[cand][0] <= t <= times[cand][-1]]
        want = {(i, u): np.interp(times[ref][i], times[cand], values[cand][:, u]) - values[ref][i, u] for i in inside for u in range(3)}
        found = {(r.ref_row, r.unit_id): r.delta for r in got if (r.ref_run, r.cand_run) == (ref, cand)}
        assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_a_refused_pair_lists_all_its_fields(spark):
    m = manifests(spark, a={}, b={"model_fingerprint": "other", "vertex_count": None, "hemisphere_ranges": {"left": [0, 3]}}, c={"stimulus_sha256": "a"}, d={})
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "a"), ("a", "zz")], PAIRS)
    got = {r.cand_run: r for r in V.comparability_report(m, pairs).collect()}
    fields = {k: [i.field for i in r.issues] for k, r in got.items()}
    assert fields["b"] == ["model_fingerprint", "vertex_count", "hemisphere_ranges"]
    assert fields["c"] == ["stimulus_sha256"] and fields["d"] == [] and fields["a"] == ["run_id", "stimulus_sha256"]
    assert len(fields["zz"]) == 6 and not got["zz"].comparable  # no manifest
    assert got["b"].checks == {"run_id": True, "stimulus_sha256": True, "model_fingerprint": False, "vertex_count": False, "hemisphere_ranges": False, "atlas_version": True}
    with pytest.raises(V.NotComparable, match="a and b: model_fingerprint, vertex_count, hemisphere_ranges"):
        V.require_comparable(V.comparability_report(m, pairs))
    V.require_comparable(V.comparability_report(m, pairs.where("cand_run = 'd'")))


def test_refusal_comes_before_the_panel_is_read(spark):
    from pyspark.sql import functions as F

    trap = panel(spark, {"a": [[1.0]], "b": [[2.0]]}).withColumn("value", F.raise_error(F.lit("the panel was read")).cast("double"))
    m = manifests(spark, a={}, b={"model_fingerprint": "x"})
    with pytest.raises(V.NotComparable):
        V.compare_variants(trap, units(spark, [0]), spark.createDataFrame([("a", "b")], PAIRS), m)


def test_comparison_of_two_candidates(spark):
    base = [[1.0, 2, 3, 4], [2, 4, 6, 8], [1, 1, 1, 1]]
    other = [[2.0, 1, 5, 2], [4, 2, 10, 4], [1, 1, 1, 1]]
    p = panel(spark, {"a": base, "b": other, "c": base, "d": other})
    m = manifests(spark, a={}, b={}, c={}, d={"model_fingerprint": "x"})
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], PAIRS)
    for method in (V.EXACT, V.LINEAR):
        found = V.compare_variants(p, units(spark, [0, 0, 1, 1]), pairs, m, method, refuse=False)
        got = {r.cand_run: r for r in V.summary(found).collect()}
        assert (got["b"].events, got["b"].peak_time, got["b"].aligned_samples, got["b"].regions) == (1, 1.0, 3, 2)
        assert abs(got["b"].peak_rms - np.sqrt((4 + 4 + 16 + 16) / 4)) < 1e-12
        assert got["c"].events is None and got["c"].windows is None and got["c"].aligned_samples == 3
        assert (got["d"].comparable, got["d"].refused_fields, got["d"].aligned_samples) == (False, "model_fingerprint", None)


def test_swapped_runs_negate_every_delta(spark):
    rng = np.random.default_rng(1)
    p = panel(spark, {k: rng.normal(size=(6, 4)).tolist() for k in "ab"})
    signs = {}
    for ref, cand in ("ab", "ba"):
        found = V.compare_variants(p, units(spark, [0, 0, 1, 1]), spark.createDataFrame([(ref, cand)], PAIRS))
        signs[ref] = {r.region_id: r.mean_signed_delta for r in found.regions.collect()}
    assert all(abs(signs["a"][k] + signs["b"][k]) < 1e-12 for k in (0, 1))


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="unsupported"):
        V.align(timeline(spark, a=[0]), spark.createDataFrame([], PAIRS), "cubic")
