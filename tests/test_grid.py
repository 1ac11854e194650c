import math

import numpy as np
import pytest

from tidemark.operators.intervals import content_summary, feature_grid

RATE, DURATION = 0.5, {"a": 41.0, "b": 6.0, "c": 0.0}


def tables():
    rng = np.random.default_rng(3)
    times = np.sort(rng.uniform(4, 35, 25))
    samples = [("a", float(t), float(v), float(v * v)) for t, v in zip(times, rng.normal(size=25), strict=True)]
    samples += [("b", 1.0, 5.0, 25.0), ("b", None, 9.0, 9.0), ("c", 0.5, 1.0, 1.0)]
    spans = [("a", 0.0, 10.0, 1), ("a", 10.0, 11.0, 7), ("a", 11.0, 41.0, 3), ("b", 2.0, 4.0, 2)]
    cuts = [("a", 0.0), ("a", 12.2), ("a", 12.9), ("a", 400.0), ("a", None), ("b", 3.0)]
    return samples, spans, cuts


def brute(samples, spans, cuts):
    rows = []
    for run, duration in DURATION.items():
        if duration <= 0:
            continue
        count = max(1, math.ceil(duration * RATE))
        grid = [min((i + 0.5) / RATE, duration) for i in range(count)]
        own = [s for s in samples if s[0] == run and s[1] is not None]
        at = [s[1] for s in own]
        hits = {min(max(round(t * RATE - 0.5), 0), count - 1) for r, t in cuts if r == run and t is not None}
        ends = max((e for r, _, e, _ in spans if r == run), default=None)
        for step, t in enumerate(grid):
            found = [n for r, s, e, n in spans if r == run and s <= t and (t < e or t == e == ends)]
            rows.append((
                run, step, *[float(np.interp(t, at, [s[i] for s in own])) for i in (2, 3)], float(at[0] <= t <= at[-1]),
                0.0, 0.0, float(found[0]) if found else 0.0, float(bool(found)), float(step in hits),
            ))
    return sorted(rows)


@pytest.mark.parametrize("width", [None, 7.0])
def test_grid_matches_interpolation_and_stabs(spark, width):
    samples, spans, cuts = tables()
    frame = spark.createDataFrame(samples, "run_id string, t double, v double, w double")
    got = feature_grid(
        spark.createDataFrame(list(DURATION.items()), "run_id string, duration double"), RATE,
        {"seen": (frame, ["v", "w"]), "heard": (frame.where("false").withColumnRenamed("v", "loud"), ["loud"])},
        spark.createDataFrame(spans, "run_id string, span_start double, span_end double, n int"), ["n"],
        spark.createDataFrame(cuts, "run_id string, t double"), width,
    )
    names = ["run_id", "step", "v", "w", "seen_available", "loud", "heard_available", "n", "content_event_available", "shot_change"]
    rows, wanted = sorted(map(tuple, got.select(*names).collect())), brute(samples, spans, cuts)
    assert [r[:2] for r in rows] == [w[:2] for w in wanted]
    assert np.allclose([r[2:] for r in rows], [w[2:] for w in wanted])


def test_grid_lays_the_rows_out_once(spark):
    samples, spans, cuts = tables()
    frame = spark.createDataFrame(samples, "run_id string, t double, v double, w double")
    runs = spark.createDataFrame(list(DURATION.items()), "run_id string, duration double")
    spans = spark.createDataFrame(spans, "run_id string, span_start double, span_end double, n int")
    got = feature_grid(runs, RATE, {"seen": (frame, ["v", "w"])}, spans, ["n"], spark.createDataFrame(cuts, "run_id string, t double").hint("broadcast"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 2
    done = got._jdf.queryExecution().executedPlan().toString()
    assert done.count("Exchange hashpartitioning(run_id") <= 3  # the union once, the two sides of cuts and runs at most


@pytest.mark.parametrize("width", [None, 7.0])
def test_summary_of_full_empty_and_lengthless_runs(spark, width):
    rows = [
        ("a", "shot", 0.0, 30.0, "shot", None), ("a", "shot", 30.0, 40.0, "shot", None), ("a", "shot", 40.0, 40.0, "shot", None),
        ("a", "speech", 1.0, 5.0, "speech", " one  two\tthree "), ("a", "speech", 4.0, 7.0, "speech", None), ("a", "speech", 90.0, 130.0, "speech", "four"),
        ("a", "audio", 0.0, 30.0, "silence", None), ("a", "audio", 20.0, 40.0, "silence", None), ("a", "audio", 35.0, 60.0, "music", None),
        ("a", "audio", 60.0, 66.0, None, None), ("a", "cta", 9.0, 9.5, "cta", None), ("a", "cta", 8.0, 9.5, "cta", None), ("c", "shot", 0.0, 1.0, "shot", None),
    ]
    iv = spark.createDataFrame(rows, "run_id string, kind string, start_t double, end_t double, label string, text string")
    runs = spark.createDataFrame([("a", 120.0), ("b", 60.0), ("c", 0.0)], "run_id string, duration double")
    scenes = spark.createDataFrame([("a",), ("a",)], "run_id string")
    signals = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0)], "run_id string, value double")
    got = {x.run_id: x.asDict() for x in content_summary(runs, iv, scenes, signals, width).collect()}
    assert {k: v for k, v in got["a"].items() if k != "run_id"} == pytest.approx({
        "shot_count": 3, "scene_count": 2, "utterances": 3, "word_count": 4, "overlay_count": 0, "cta_count": 2, "mean_shot": 20.0,
        "median_shot": 20.0, "cuts_per_minute": 1.0, "words_per_minute": 2.0, "first_cta": 8.0, "mean_signal": 1.5,
        "speech_fraction": 36 / 120, "audio_fraction": 66 / 120, "silence_fraction": 40 / 120, "music_fraction": 25 / 120,
    })
    assert got["b"]["shot_count"] == got["b"]["word_count"] == got["b"]["speech_fraction"] == 0
    assert got["b"]["cuts_per_minute"] is got["b"]["words_per_minute"] is got["b"]["mean_shot"] is got["b"]["first_cta"] is None
    assert got["c"]["shot_count"] == 1 and got["c"]["cuts_per_minute"] is got["c"]["silence_fraction"] is None
