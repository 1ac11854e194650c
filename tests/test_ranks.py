import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranks import exact_quantiles, ranked, top_k


def test_bracketed_quantiles_are_exact_on_a_hot_group(spark):
    rng = random.Random(1)
    hot = [rng.gauss(0, 5) if i % 4 else float(i % 7) for i in range(20_000)]
    rows = [("hot", v) for v in hot] + [("cold", 1.0), ("cold", 4.0), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, hot_rows=0).collect()}
    for k, values in (("hot", hot), ("cold", [1.0, 4.0])):
        for name, p in probs.items():
            assert abs(got[k][name] - np.percentile(values, p * 100)) < 1e-9


def test_quantiles_are_rounded_as_the_sql_rounds_them(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    rows = [(g, v) for g in range(300) for v in [round(rng.uniform(0, 500), 2) ** 0.5 for _ in range(rng.randint(1, 30))] * (1 + g % 2 * 5)]
    df = spark.createDataFrame(rows, "k long, v double")
    probs = {"a": 0.6, "b": 0.95, "c": 0.25, "d": 0.5}
    pdf = df.toPandas()  # noqa: F841
    wanted = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in probs.items())
    want = {r[0]: r for r in duckdb.sql(f"SELECT k, {wanted} FROM pdf GROUP BY k").fetchall()}
    for hot_rows in (500_000, 0):
        got = exact_quantiles(df, ["k"], "v", probs, hot_rows=hot_rows).select("k", *probs).collect()
        assert {r["k"]: tuple(r) for r in got} == want


def test_quantiles_without_keys_or_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert exact_quantiles(df.where("v > 5"), [], "v", {"m": 0.5}).first()["m"] is None


def test_ranks_of_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 50 == 0).alias("k"), "id", (F.xxhash64("id") % 100).alias("v"))
    order = [F.col("v").desc(), F.col("id").asc()]
    a = ranked(df, ["k"], order, hot_rows=100)
    b = ranked(df, ["k"], order)
    key = lambda x: sorted(map(tuple, x.select("k", "id", "rank").collect()))
    assert key(a) == key(b)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
