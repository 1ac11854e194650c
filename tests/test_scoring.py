import random

import pytest

from tidemark.functions.registry import METRICS
from tidemark.operators import improve as M
from tidemark.operators import pareto as PF
from tidemark.operators import scoring as S
from tidemark.operators.scoring import Objective, Scope


def variants(spark, runs):
    rows = [(k, i, float(i), "u", float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id string, row_idx int, t double, unit_id string, value double")


def run(spark, runs, *objectives, baseline=None):
    p = variants(spark, runs)
    du = p.select("run_id").distinct().selectExpr("run_id", "10.0D AS duration")
    windows = S.resolve_windows(p, du, objectives)
    return S.score_experiment(S.target_series(p, objectives), windows, objectives, baseline)


@pytest.mark.parametrize("metric,a,b,raw,order", [
    ("MEAN_RESPONSE", [1, 2, 3], [2, 3, 4], {"A": 2.0, "B": 3.0}, ["B", "A"]),
    ("PEAK_RESPONSE", [1, 5, 2], [2, 4, 3], {"A": 5.0, "B": 4.0}, ["A", "B"]),
    ("INTEGRATED_RESPONSE", [0, 2, 0], [1, 1, 1], {"A": 2.0, "B": 2.0}, ["A", "B"]),
    ("TEMPORAL_CHANGE_MAGNITUDE", [0, 2, 0], [1, 1, 1], {"A": 2.0, "B": 0.0}, ["A", "B"]),
])
def test_metrics_and_ranking(spark, metric, a, b, raw, order):
    scores, ranking = run(spark, {"A": a, "B": b}, Objective("o", metric))
    assert {r.run_id: r.raw_value for r in scores.collect()} == raw
    assert [r.run_id for r in ranking.orderBy("rank").collect()] == order


def test_missing_scores_leave_the_composite_empty(spark):
    scores, ranking = run(
        spark, {"A": [1, 2, 3, 9], "B": [2, 3]}, Objective("o", "MEAN_RESPONSE"), Objective("late", "MEAN_RESPONSE", scope=Scope("absolute", 2.0, 9.0))
    )
    got = {r.run_id: (r.total_score, r.rank) for r in ranking.collect()}
    assert got["B"] == (None, None) and got["A"][1] == 1
    reasons = {(r.run_id, r.objective_id): r.reason for r in scores.collect()}
    assert reasons[("B", "late")] == "no samples in window" and reasons[("A", "late")] is None


def test_degenerate_normalisation(spark):
    scores, _ = run(spark, {"A": [1, 1], "B": [1, 1]}, Objective("x", "MEAN_RESPONSE"), Objective("z", "MEAN_RESPONSE", normalization="z_score"))
    assert {(r.objective_id, r.normalized) for r in scores.collect()} == {("x", 0.5), ("z", 0.0)}


def test_weights_and_spec_checks():
    assert S.normalized_weights([Objective("a", "MEAN_RESPONSE", weight=0), Objective("b", "MEAN_RESPONSE", weight=0)]) == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        Objective("a", "NOT_A_METRIC")
    with pytest.raises(ValueError):
        Objective("a", "MEAN_RESPONSE", direction="target")
    with pytest.raises(ValueError):
        METRICS.add("MEAN_RESPONSE", lambda: None, "x", "y")
    with pytest.raises(ValueError):
        METRICS.add("UNDOCUMENTED", lambda: None, "", "y")


def test_front_equals_brute_force_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(PF, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    pts = [(i, rng.randint(0, 12), rng.randint(0, 12), rng.randint(0, 12)) for i in range(250)]
    df = spark.createDataFrame(pts, "id int, a int, b int, c int").repartition(6)
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:], strict=True)) and x[1:] != y[1:]
    front = {p[0] for p in pts if not any(beats(q, p) for q in pts)}
    found = PF.pareto_front(df, "id", ["a", "b", "c"])
    assert {r.id for r in found.collect()} == front
    dom = {r.id: (r.dominators, r.witness) for r in PF.dominators(df, found, "id", ["a", "b", "c"]).collect()}
    for p in pts:
        want = sorted(q[0] for q in pts if q[0] in front and beats(q, p))
        assert dom.get(p[0]) == ((len(want), want[0]) if want else None)


def test_outcomes_follow_direction(spark):
    df = spark.createDataFrame(
        [("maximize", None, 1.0, 2.0), ("minimize", None, 1.0, 2.0), ("target", 3.0, 1.0, 2.0), ("maximize", None, 1.0, 1.01), ("maximize", None, None, 1.0)],
        "direction string, target_value double, parent_value double, candidate_value double",
    )
    assert [r.outcome for r in M.outcomes(df, 0.1).collect()] == ["improved", "worsened", "improved", "unchanged", "inconclusive"]


def test_sums_of_a_run_are_taken_in_the_order_of_its_rows(spark):
    """As the SQL adds them: two runs of the same samples tie, and a sample at a threshold falls as there."""
    value = [round(((i * 7919) % 10007) / 37, 2) for i in range(300)]
    rows = [(run, i, float((i * 101) % 300), v) for run in range(20) for i, v in enumerate(value)]
    random.Random(3).shuffle(rows)
    series = spark.createDataFrame(rows, "run_id long, row_idx long, t double, value double").repartition(7).selectExpr("*", "'m' AS objective_id")
    windows = series.select("run_id", "objective_id").distinct().selectExpr("*", "-1D AS start_t", "1e9 AS end_t", "CAST(NULL AS string) AS reason")
    got = S.evaluate(series, windows, (Objective("m", "MEAN_RESPONSE"),)).collect()
    total = 0.0
    for v in value:
        total += v
    assert [r["raw_value"] for r in got] == [total / len(value)] * 20

    shares = M.contribution_shares(series.withColumnRenamed("value", "contribution")).collect()
    assert sorted((r["run_id"], r["share"]) for r in shares) == sorted((run, v / total) for run, _, _, v in rows)
