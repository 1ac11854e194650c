import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as K
from tidemark.operators import surrogate as G
from tidemark.operators.candidates import Parameter

SPACE = (
    Parameter("gain", "continuous", -10.0, 10.0, resolution=0.1),
    Parameter("brightness", "continuous", -1.0, 1.0, resolution=0.01),
    Parameter("cut", "integer", 0, 4),
    Parameter("style", "categorical", choices=(0.0, 1.0, 2.0)),
)


@pytest.fixture(scope="module")
def points(spark):
    return K.random_candidates(spark.range(400).withColumnRenamed("id", "candidate_id"), "candidate_id", SPACE, 1)


def test_random_points_are_legal_and_do_not_depend_on_partitioning(spark, points):
    assert points.where(F.size(K.violations(SPACE)) > 0).count() == 0
    again = K.random_candidates(spark.range(400).withColumnRenamed("id", "candidate_id").repartition(7), "candidate_id", SPACE, 1)
    key = lambda df: sorted((r.candidate_id, sorted(r["values"].items())) for r in df.collect())
    assert key(points) == key(again)


def test_mutation_always_touches_something_and_stays_legal(points):
    out = K.mutate(points, "candidate_id", SPACE, 3, "large", rate=0.05)
    assert out.where(F.size(K.violations(SPACE)) > 0).count() == 0
    changed = out.join(points.withColumnRenamed("values", "before"), out.parent_id == points.candidate_id)
    same = changed.where(F.sort_array(F.map_entries("values")) == F.sort_array(F.map_entries("before"))).count()
    assert same < 60  # clamping and rounding may undo a step, most points move


def test_crossover_takes_every_value_from_a_parent(points):
    left = points.where("candidate_id < 200").select(F.col("candidate_id").alias("left_id"), F.col("values").alias("left_values"))
    right = points.where("candidate_id >= 200").select(F.col("candidate_id").alias("right_id"), (F.col("candidate_id") - 200).alias("left_id"), F.col("values").alias("right_values"))
    pairs = left.join(right, "left_id")
    kids = K.crossover(pairs, SPACE, 5).join(pairs, F.col("parents")[0] == F.col("left_id"))
    for p in SPACE:
        assert kids.where((K.get(p) != K.get(p, "left_values")) & (K.get(p) != K.get(p, "right_values"))).count() == 0


def test_grid_is_complete_and_refuses_excess(spark):
    g = K.grid(spark, SPACE, 3, limit=10_000)
    assert g.count() == 3 * 3 * 5 * 3 and g.select(K.fingerprint(SPACE)).distinct().count() == 135
    with pytest.raises(ValueError):
        K.grid(spark, SPACE, 3, limit=100)


def test_diversity_without_pairs(points):
    rows = [r["values"] for r in points.where("candidate_id < 40").collect()]
    d = lambda a, b: (abs(a["gain"] - b["gain"]) / 20 + abs(a["brightness"] - b["brightness"]) / 2 + abs(a["cut"] - b["cut"]) / 4 + (a["style"] != b["style"])) / 4
    pairs = list(itertools.combinations(rows, 2))
    got = K.pairwise_diversity(points.where("candidate_id < 40").withColumn("k", F.lit(0)), ["k"], SPACE).first()
    assert abs(got.diversity - sum(d(a, b) for a, b in pairs) / len(pairs)) < 1e-9
    assert K.pairwise_diversity(points.where("candidate_id = 1").withColumn("k", F.lit(0)), ["k"], SPACE).first().diversity is None


def test_novelty_selection_matches_the_greedy_rule(points):
    scored = points.where("candidate_id < 60").withColumn("fitness", F.col("candidate_id") % 13 / 3.0)
    rows = {r.candidate_id: (r["values"], r.fitness) for r in scored.collect()}
    d = lambda a, b: (abs(a["gain"] - b["gain"]) / 20 + abs(a["brightness"] - b["brightness"]) / 2 + abs(a["cut"] - b["cut"]) / 4 + (a["style"] != b["style"])) / 4
    lo, hi = min(f for _, f in rows.values()), max(f for _, f in rows.values())
    order = sorted(rows, key=lambda i: (-rows[i][1], i))
    want = [order[0]]
    while len(want) < 5:
        mix = lambda i: 0.4 * (rows[i][1] - lo) / (hi - lo) + 0.6 * min(d(rows[i][0], rows[w][0]) for w in want)
        want.append(max((i for i in order if i not in want), key=mix))
    assert [c["_id"] for c in K.greedy_batch(scored, "candidate_id", SPACE, F.col("fitness"), 5, novelty_weight=0.6)] == want


def test_batch_relaxes_to_fill(points):
    few = points.where("candidate_id < 3").withColumn("fitness", F.col("candidate_id") * 1.0)
    out = K.greedy_batch(few, "candidate_id", SPACE, F.col("fitness"), 3, minimum_distance=0.99)
    assert [c["_id"] for c in out] == [2, 1, 0] and [c["relaxed"] for c in out] == [False, True, True]


def test_acquisition_closed_forms(spark):
    df = spark.createDataFrame([(0.5, 0.1), (0.7, 0.0)], "m double, s double")
    m, s, best = F.col("m"), F.col("s"), F.lit(0.5)
    got = df.select(*[G.acquisition(n, m, s, best).alias(n) for n in ("upper_confidence_bound", "expected_improvement", "probability_of_improvement")]).collect()
    assert abs(got[0].upper_confidence_bound - 0.7) < 1e-12
    assert abs(got[0].expected_improvement - 0.1 / math.sqrt(2 * math.pi)) < 1e-12 and abs(got[0].probability_of_improvement - 0.5) < 1e-12
    assert abs(got[1].expected_improvement - 0.2) < 1e-12 and got[1].probability_of_improvement == 1.0
    with pytest.raises(ValueError):
        G.acquisition("expected_improvement", m, s)


@pytest.mark.parametrize("chunked", [False, True])
def test_kendall_with_ties(spark, monkeypatch, chunked):
    if chunked:
        monkeypatch.setattr(G, "TARGET_ROWS", 8)
    rows = [(i * 37 % 23, i * 11 % 19) for i in range(90)]
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in rows], "k int, a double, b double")
    sign = lambda x: (x > 0) - (x < 0)
    num = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        num += sign(a - c) * sign(b - d)
        tx += a == c
        ty += b == d
    pairs = 90 * 89 / 2
    want = num / math.sqrt((pairs - tx) * (pairs - ty))
    assert abs(G.kendall(df, ["k"], "a", "b").first().kendall - want) < 1e-12


def test_dataset_hash_ignores_order(spark):
    rows = [(0, i, i / 7) for i in range(50)]
    h = lambda rs: G.dataset_hash(spark.createDataFrame(rs, "k int, i int, v double"), ["k"], [F.col("i").cast("string"), F.col("v").cast("string")], "i").first().dataset_hash
    assert h(rows) == h(rows[::-1]) != h([*rows[:-1], (0, 49, 1.0)])
