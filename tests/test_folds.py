"""Order-dependent rules against direct brute force."""

import difflib
import random
import re

import numpy as np
import pytest

from tidemark.operators import intervals as I
from tidemark.operators import vectors as V


def chain(rng, n):
    t, out = 0.0, []
    for i in range(n):
        end = t + rng.choice([0.1, 0.2, 0.4, 1.0, 3.0])
        out.append((round(t, 4), round(end, 4), "abc"[i % 3], float(i)))
        t = end
    return out


@pytest.mark.parametrize("width", [None, 2.0])
def test_absorb_short(spark, width):
    rng = random.Random(9)
    runs = {f"r{k}": chain(rng, n) for k, n in enumerate((40, 7, 1, 2))}
    rows = [(run, *seg) for run, segs in runs.items() for seg in segs]
    df = spark.createDataFrame(rows, "run_id string, start_t double, end_t double, label string, mean_value double")
    got = sorted((r.run_id, r.start_t, r.end_t, r.label, round(r.mean_value, 9)) for r in I.absorb_short(df, 0.5, width).collect())
    want = []
    for run, segs in runs.items():
        merged = [list(s) for s in segs]
        while len(merged) > 1:
            i = next((k for k, s in enumerate(merged) if s[1] - s[0] < 0.5), None)
            if i is None:
                break
            if i == 0:
                j = 1
            elif i == len(merged) - 1:
                j = i - 1
            else:
                left, right = merged[i - 1], merged[i + 1]
                j = i - 1 if left[1] - left[0] >= right[1] - right[0] else i + 1
            a, k = merged[i], merged[j]
            da, dk = a[1] - a[0], k[1] - k[0]
            lo, hi = sorted((i, j))
            merged[lo : hi + 1] = [[min(a[0], k[0]), max(a[1], k[1]), k[2], (a[3] * da + k[3] * dk) / (da + dk)]]
        want += [(run, s[0], s[1], s[2], round(s[3], 9)) for s in merged]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [None, 1.0])
def test_boundaries_are_anchored_not_chained(spark, width):
    times = [0.1, 0.4, 0.7, 1.0, 2.0, 2.39, 2.41, 9.0]
    kinds = ["content", "adaptive", "adaptive", "threshold", "adaptive", "other", "content", "other"]
    df = spark.createDataFrame([("r", t, k) for t, k in zip(times, kinds, strict=True)], "run_id string, t double, detector string")
    got = [(round(r.t, 3), r.transition) for r in I.cluster_boundaries(df, 0.4, width).orderBy("t").collect()]
    assert got == [(0.0, "start"), (0.7, "fade"), (2.0, "gradual"), (2.41, "cut"), (9.0, "unknown")]


def test_scene_cap_counts_from_the_scene_start(spark):
    rows = [("r", float(i * 6), float(i * 6 + 6), 0.95, False) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id string, start_t double, end_t double, similar double, bridged boolean")
    got = [(r.start_t, r.end_t, r.shots) for r in I.group_scenes(df, 0.86, 20.0, 5.0).orderBy("start_t").collect()]
    assert got == [(0.0, 18.0, 3), (18.0, 36.0, 3), (36.0, 48.0, 2)]


def test_merge_texts(spark):
    rng = random.Random(2)
    words = ["Buy now today", "buy NOW today!", "Learn more here", "learn mor here", "zzz", "!!!"]
    rows, t = [], 0.0
    for i in range(40):
        t += rng.choice([0.5, 1.0, 4.0])
        rows.append(("r", t, i, rng.choice(words), rng.random()))
    df = spark.createDataFrame(rows, "run_id string, t double, idx int, text string, confidence double")
    got = sorted((r.start_t, r.end_t, r.text, r.occurrences, round(r.confidence, 9)) for r in I.merge_texts(df, 1.0).collect())
    groups: list[dict] = []
    for _, t, _, text, c in rows:
        key = " ".join(re.sub(r"[^a-z0-9 ]+", " ", text.lower()).split())
        if not key:
            continue
        for g in groups:
            if t - g["last"] <= 2.5 and difflib.SequenceMatcher(None, key, g["key"]).ratio() >= 0.72:
                g["last"], g["cs"] = t, [*g["cs"], c]
                if c > g["best"]:
                    g["text"], g["best"] = text, c
                break
        else:
            groups.append({"key": key, "text": text, "first": t, "last": t, "best": c, "cs": [c]})
    assert got == sorted((g["first"], g["last"] + 1.0, g["text"], len(g["cs"]), round(sum(g["cs"]) / len(g["cs"]), 9)) for g in groups)


def test_streamed_clusters_and_separation(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 8))
    rows = [(g, i, (centres[(i * 7 + g) % 3] + rng.normal(size=8) * 0.2).tolist()) for g in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    labels = V.cluster_in_order(df, "g", "i", "v", 0.3)
    got = {(r.g, r.i): r.cluster for r in labels.collect()}
    for g in range(2):
        cs: list[np.ndarray] = []
        for gg, i, v in rows:
            if gg != g:
                continue
            x = np.array(v) / np.linalg.norm(v)
            for k, c in enumerate(cs):
                if 1 - x @ c <= 0.3:
                    cs[k] = (c + x) / np.linalg.norm(c + x)
                    break
            else:
                cs.append(x)
                k = len(cs) - 1
            assert got[(g, i)] == k
    sep = {r.g: r.separation for r in V.separation(V.nearest_other(df.join(labels, ["g", "i"]), "g", "i", "v", "cluster"), "g", "cluster").collect()}
    for g in range(2):
        m = np.stack([np.array(v) / np.linalg.norm(v) for gg, _, v in rows if gg == g])
        lab = [got[(g, i)] for i in range(30)]
        d = 1 - m @ m.T
        scores = []
        for i in range(30):
            same = [d[i, j] for j in range(30) if j != i and lab[j] == lab[i]]
            other = [d[i, j] for j in range(30) if lab[j] != lab[i]]
            if same and other:
                scores.append((min(other) - np.mean(same)) / max(min(other), np.mean(same)))
        assert abs(sep[g] - np.mean(scores)) < 1e-9


def test_boundary_grid(spark):
    iv = spark.createDataFrame([("r", "shot", 0.0, 6.0), ("r", "shot", 6.0, 10.0), ("r", "speech", 3.0, 5.0), ("r", "audio", 0.0, 10.0), ("s", "shot", 0.01, 9.0)], "run_id string, kind string, start_t double, end_t double")
    du = spark.createDataFrame([("r", 10.0), ("s", 5.0)], "run_id string, duration double")
    got: dict[str, list[float]] = {}
    for r in I.boundaries(iv, du).orderBy("t").collect():
        got.setdefault(r.run_id, []).append(r.t)
    assert got == {"r": [0.0, 3.0, 5.0, 6.0, 10.0], "s": [0.0, 0.01, 5.0]}
    spans = I.spans_between(I.boundaries(iv, du))
    assert I.partition_violations(spans).count() == 0
