"""Committed parts, generations, models, and windows over a stored timeline."""

import random

import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from tidemark.operators import candidates as K
from tidemark.operators import surrogate as G
from tidemark.operators.candidates import Parameter
from tidemark.sources.versions import ModelStore, Parts, SearchStore, TimelineStore


def test_a_half_written_generation_is_invisible(spark, tmp_path):
    store = SearchStore(spark, str(tmp_path))
    gen = lambda g: [spark.createDataFrame([("s", g, float(g + k)) for k in range(3)], "search_id string, generation int, best double")] * 3
    with pytest.raises(FileNotFoundError):
        store.read("evaluations")
    store.write_generation(0, *gen(0))
    store.write_generation(1, *gen(1), commit=False)
    assert {r.generation for r in store.read("evaluations").collect()} == {0} and store.current_states().first().generation == 0
    store.write_generation(1, *gen(5))  # the next attempt replaces what was left
    assert sorted(r.best for r in store.read("populations").where("part = 'g000001'").collect()) == [5.0, 6.0, 7.0]
    assert store.latest()["seq"] == 1
    with pytest.raises(FileExistsError):
        store.write_generation(1, *gen(1))
    with pytest.raises(Exception, match="exist"):
        store.commit("g000001", 1)


def test_nothing_committed_yet(spark, tmp_path):
    store = Parts(spark, str(tmp_path))
    assert store.commits().count() == 0 and store.latest() is None and store.read("x", "a int").columns == ["a", "part"]


def test_a_model_predicts_the_same_after_reading(spark, tmp_path):
    rng = random.Random(1)
    train = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(80)], "candidate_id int, a double, b double").withColumn("fitness", F.col("a") * 3 - F.col("b"))
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.load(RandomForestRegressionModel)
    models = [G.fit(train.where(f"candidate_id % {k} = 0"), ["a", "b"], seed=k) for k in (2, 1)]
    for version, model in enumerate(models):
        store.save(version, model, train, spark.createDataFrame([(version, 0.5)], "round int, error double"), mae="0.5")
    values = lambda m: [(r.candidate_id, r.predicted, r.sigma) for r in G.predict(m, train, ["a", "b"]).orderBy("candidate_id").collect()]
    for version, model in enumerate(models):
        assert values(store.load(RandomForestRegressionModel, version)) == values(model)
    assert values(store.load(RandomForestRegressionModel)) == values(models[1]) and store.latest()["mae"] == "0.5"
    with pytest.raises(FileNotFoundError):
        store.load(RandomForestRegressionModel, 7)


def spans(n=1500):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        start = rng.random() * 5000
        rows.append((rng.choice([1, 1, 1, 2]), i, start, start + rng.choice([0.5, 3.0, 20.0, 200.0, 1500.0]) * rng.random()))
    return rows


def test_windows_match_a_scan_and_open_few_files(spark, tmp_path):
    rows = spans()
    store = TimelineStore(spark, str(tmp_path), width=4.0, levels=3, groups=2)
    store.write("iv", spark.createDataFrame(rows, "run_id long, idx int, s double, e double"), "s", "e")
    for low, high in ((0.0, 1.0), (999.0, 1001.0), (4990.0, 6000.0), (2000.0, 2300.0), (-50.0, -1.0)):
        got = store.window("iv", low, high)
        assert got.columns == ["run_id", "idx", "s", "e"]
        assert sorted(r.idx for r in got.collect()) == sorted(i for _, i, s, e in rows if s < high and e > low)
        one = store.window("iv", low, high, runs=[2])
        assert sorted(r.idx for r in one.collect()) == sorted(i for run, i, s, e in rows if run == 2 and s < high and e > low)
    with pytest.raises(FileExistsError):
        store.write("iv", spark.createDataFrame(rows, "run_id long, idx int, s double, e double"), "s", "e")


def test_a_window_reads_under_a_twentieth_of_a_long_run(spark, tmp_path):
    rows = [(1, i, i * 0.5, i * 0.5 + (i % 7) * 0.3) for i in range(20_000)]
    store = TimelineStore(spark, str(tmp_path), width=25.0, levels=2)
    store.write("iv", spark.createDataFrame(rows, "run_id long, idx int, s double, e double"), "s", "e")
    everything = len(spark.read.parquet(f"{tmp_path}/iv").inputFiles())
    near = store.window("iv", 5000.0, 5002.0)
    assert sorted(r.idx for r in near.collect()) == [i for _, i, s, e in rows if s < 5002 and e > 5000]
    leaves = near._jdf.queryExecution().executedPlan().collectLeaves()
    assert 0 < leaves.apply(0).metrics().apply("numFiles").value() < 0.05 * everything


def test_spans_around_points(spark, tmp_path):
    rows, rng = spans(800), random.Random(3)
    store = TimelineStore(spark, str(tmp_path), width=4.0, levels=3, groups=3)
    store.write("iv", spark.createDataFrame(rows, "run_id long, idx int, s double, e double"), "s", "e")
    points = [(rng.choice([1, 2, 3]), k, (a := rng.random() * 5200 - 100), a + rng.random() * 30) for k in range(200)]
    got = store.around("iv", spark.createDataFrame(points, "run_id long, k int, a double, b double"), "a", "b").collect()
    want = [(k, i) for pr, k, a, b in points for run, i, s, e in rows if run == pr and s < b and e > a]
    assert sorted((r.k, r.idx) for r in got) == sorted(want)


def test_an_empty_timeline(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path), width=4.0)
    with pytest.raises(FileNotFoundError):
        store.window("iv", 0.0, 1.0)
    store.write("iv", spark.createDataFrame([], "run_id long, s double, e double"), "s", "e")
    assert store.window("iv", 0.0, 1.0, runs=[1]).count() == 0


def test_space_sizes_and_exhaustion(spark):
    space = (Parameter("a", "integer", 0, 2), Parameter("b", "boolean", choices=(0.0, 1.0)))
    assert K.space_size(space) == 6
    assert K.space_size((Parameter("c", "continuous", -1.0, 1.0, resolution=0.1),)) == 21
    assert K.space_size((Parameter("c", "continuous", 0.05, 1.0, resolution=0.1),)) == 11  # its lower bound and ten multiples
    assert K.space_size((Parameter("c", "continuous", 0.0, 1.0, resolution=0.0),)) is None
    rows = [("x", float(a), float(b)) for a in range(3) for b in range(2)] * 2 + [("y", 0.0, 0.0)] * 9
    ev = spark.createDataFrame(rows, "search_id string, a double, b double").withColumn("values", F.create_map(F.lit("a"), "a", F.lit("b"), "b"))
    got = {r.search_id: (r.seen, r.left) for r in K.space_left(ev, ["search_id"], space).collect()}
    assert got == {"x": (6, 0.0), "y": (1, 5.0)}
