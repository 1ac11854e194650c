"""Model-guided screening: parts as evaluated candidates, their fitness as the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import r
from tidemark.operators import candidates as K
from tidemark.operators import pareto as PF
from tidemark.operators import surrogate as G
from tidemark.operators.vectors import nearest_distance
from tidemark.plans.candidate_queries import E0, EV, SPACE, _flat, evaluations
from tidemark.plans.registry import query
from tidemark.session import durable, spread_rows
from tidemark.sources.tables import table

# Predicted value and spread stand in for a model's output where SQL has to follow.
PRD = """pr AS (SELECT *, fitness AS actual, fitness * 0.8 + (candidate_id % 11) - 5 AS predicted, 1 + (candidate_id % 13) / 4.0::DOUBLE AS sigma FROM ev WHERE usable)"""
P0 = f"{E0}, {PRD}"


def _predicted(spark, d):
    ev = evaluations(spark, d).where("usable")
    i = F.col("candidate_id")
    return ev.withColumn("actual", F.col("fitness")).withColumn("predicted", F.col("fitness") * 0.8 + (i % 11) - 5).withColumn("sigma", 1 + (i % 13) / F.lit(4.0))


@query("x19_feature_encoding", f"{E0} SELECT candidate_id, round((bright + 1) / 2, 8) AS x0, flip AS x1, round((gain + 10) / 20, 8) AS x2, round(speed / 6, 8) AS x3, CASE WHEN style = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x4, CASE WHEN style = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS x5, CASE WHEN style = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS x6 FROM ev")
def x19(spark, d):
    enc, names = G.encode(evaluations(spark, d), SPACE)
    return enc.select("candidate_id", *[r(n, 8).alias(n) for n in names])


@query("x19_standard_scaling", f"{E0}, s AS (SELECT avg((gain + 10) / 20) AS m, stddev_pop((gain + 10) / 20) AS s, avg(speed / 6) AS ms, stddev_pop(speed / 6) AS ss FROM ev) SELECT candidate_id, round(((gain + 10) / 20 - m) / s, 6) + 0.0 AS x2, round((speed / 6 - ms) / ss, 6) + 0.0 AS x3 FROM ev, s")
def x19s(spark, d):
    enc, names = G.encode(evaluations(spark, d), SPACE)
    return G.standard_scale(enc.select("candidate_id", *names), names).select("candidate_id", r("x2").alias("x2"), r("x3").alias("x3"))


@query("p18_training_gate", f"{E0} SELECT CASE WHEN status = 'evaluated' THEN 'kept' WHEN status = 'evaluation_failed' THEN 'evaluation failed' ELSE 'status ' || status END AS outcome, count(*) AS n FROM ev GROUP BY 1")
def p18(spark, d):
    kept, out = G.training_set(evaluations(spark, d))
    both = kept.select(F.lit("kept").alias("outcome")).unionByName(out.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a46_target_spread", f"{E0} SELECT search_id, round(max(fitness) - min(fitness), 6) AS spread FROM ev WHERE usable GROUP BY 1")
def a46(spark, d):
    return evaluations(spark, d).where("usable").groupBy("search_id").agg(r(F.max("fitness") - F.min("fitness")).alias("spread"))


@query("a40_dataset_hash", f"{E0}, h AS (SELECT search_id, sha256(candidate_id || '|' || printf('%.4f', fitness + 0.0)) AS h FROM ev WHERE usable) SELECT search_id, sha256(concat_ws('|', count(*), sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)))) AS dataset_hash FROM h GROUP BY 1")
def a40(spark, d):
    ev = evaluations(spark, d).where("usable")
    return G.dataset_hash(ev, ["search_id"], [F.col("candidate_id").cast("string"), F.format_string("%.4f", F.col("fitness") + 0.0)], "candidate_id")


@query("a30_error_metrics", f"{P0} SELECT search_id, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS r2, round(avg(predicted - actual), 6) AS bias FROM pr GROUP BY 1")
def a30(spark, d):
    out = G.error_metrics(_predicted(spark, d), ["search_id"])
    return out.select("search_id", "n", *[r(c).alias(c) for c in ("mae", "rmse", "r2", "bias")])


RK = "rk AS (SELECT *, rank() OVER (PARTITION BY search_id ORDER BY actual) + (count(*) OVER (PARTITION BY search_id, actual) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY search_id ORDER BY predicted) + (count(*) OVER (PARTITION BY search_id, predicted) - 1) / 2.0::DOUBLE AS rb FROM pr)"


@query("a31_spearman", f"{P0}, {RK} SELECT search_id, round(corr(ra, rb), 6) AS spearman FROM rk GROUP BY 1")
def a31(spark, d):
    return G.spearman(_predicted(spark, d), ["search_id"], "actual", "predicted").withColumn("spearman", r("spearman"))


@query("a31_kendall", f"{P0}, q AS (SELECT search_id, round(actual, 1) AS a, round(predicted, 1) AS b, candidate_id FROM pr), p AS (SELECT x.search_id, sign(x.a - y.a) * sign(x.b - y.b) AS s, x.a = y.a AS ta, x.b = y.b AS tb FROM q x JOIN q y ON x.search_id = y.search_id AND x.candidate_id < y.candidate_id) SELECT search_id, round(sum(s) / sqrt((count(*) - count(*) FILTER (ta))::DOUBLE * (count(*) - count(*) FILTER (tb))), 8) AS kendall FROM p GROUP BY 1")
def a31k(spark, d):
    p = _predicted(spark, d).select("search_id", F.round("actual", 1).alias("a"), F.round("predicted", 1).alias("b"))
    return G.kendall(p, ["search_id"], "a", "b").withColumn("kendall", r("kendall", 8))


@query("u03_top_k_recall", f"{P0}, k AS (SELECT search_id, candidate_id, row_number() OVER (PARTITION BY search_id ORDER BY actual DESC, candidate_id) AS a, row_number() OVER (PARTITION BY search_id ORDER BY predicted DESC, candidate_id) AS b FROM pr) SELECT search_id, count(*) FILTER (a <= 10 AND b <= 10) / 10.0::DOUBLE AS top_k_recall FROM k GROUP BY 1")
def u03(spark, d):
    return G.top_k_recall(_predicted(spark, d), ["search_id"], "candidate_id", "actual", "predicted", 10)


@query("a48_all_metrics", f"{P0}, {RK}, s AS (SELECT search_id, round(corr(ra, rb), 6) AS spearman FROM rk GROUP BY 1), k AS (SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY actual DESC, candidate_id) AS a, row_number() OVER (PARTITION BY search_id ORDER BY predicted DESC, candidate_id) AS b FROM pr), t AS (SELECT search_id, round(count(*) FILTER (a <= 3 AND b <= 3) / 3.0::DOUBLE, 6) AS top_k_recall FROM k GROUP BY 1) SELECT search_id, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, any_value(spearman) AS spearman, any_value(top_k_recall) AS top_k_recall FROM pr JOIN s USING (search_id) JOIN t USING (search_id) GROUP BY 1")
def a48(spark, d):
    p = durable(_predicted(spark, d).select("search_id", "candidate_id", "actual", "predicted"))
    out = G.all_metrics(p, ["search_id"], "candidate_id", 3)
    return out.select("search_id", "n", r("mae").alias("mae"), r("spearman").alias("spearman"), r("top_k_recall").alias("top_k_recall"))


@query("a32_uncertainty_diagnostics", f"{P0}, e AS (SELECT search_id, sigma, abs(actual - predicted) AS e FROM pr), k AS (SELECT *, rank() OVER (PARTITION BY search_id ORDER BY sigma) + (count(*) OVER (PARTITION BY search_id, sigma) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY search_id ORDER BY e) + (count(*) OVER (PARTITION BY search_id, e) - 1) / 2.0::DOUBLE AS rb FROM e) SELECT search_id, round(avg(sigma), 6) AS mean_uncertainty, round(avg(e), 6) AS mae, round(avg(CASE WHEN e <= sigma THEN 1.0::DOUBLE ELSE 0 END), 8) AS coverage_68, round(corr(ra, rb), 5) AS error_correlation FROM k GROUP BY 1")
def a32(spark, d):
    out = G.uncertainty_diagnostics(_predicted(spark, d), ["search_id"])
    return out.select("search_id", r("mean_uncertainty").alias("mean_uncertainty"), r("mae").alias("mae"), r("coverage_68", 8).alias("coverage_68"), r("error_correlation", 5).alias("error_correlation"))


@query("p19_trust_verdict", f"{P0}, {RK}, s AS (SELECT search_id, count(*) AS n, corr(ra, rb) AS c FROM rk GROUP BY 1) SELECT search_id, CASE WHEN n < 8 THEN 'bootstrapping' WHEN c < 0.2 THEN 'rank correlation too low' ELSE 'trusted' END AS verdict FROM s")
def p19(spark, d):
    p = _predicted(spark, d)
    m = G.error_metrics(p, ["search_id"]).join(G.spearman(p, ["search_id"], "actual", "predicted"), "search_id")
    return m.select("search_id", G.trust_verdict(F.col("n"), F.col("spearman")).alias("verdict"))


@query("a36_round_diagnostics", f"{P0} SELECT search_id, generation, count(*) FILTER (cached) AS model_guided, count(*) FILTER (NOT cached) AS fallback, round(avg(abs(actual - predicted)), 6) AS mae, round(avg(predicted - actual), 6) + 0.0 AS bias FROM pr GROUP BY ALL")
def a36(spark, d):
    e = F.col("predicted") - F.col("actual")
    return _predicted(spark, d).groupBy("search_id", "generation").agg(
        F.count(F.when(F.col("cached"), 1)).alias("model_guided"), F.count(F.when(~F.col("cached"), 1)).alias("fallback"), r(F.avg(F.abs(e))).alias("mae"), r(F.avg(e)).alias("bias"))


@query("w30_error_over_rounds", f"{P0} SELECT search_id, candidate_id, row_number() OVER (PARTITION BY search_id ORDER BY sequence) AS round_no, round(abs(actual - predicted), 6) AS error FROM pr")
def w30(spark, d):
    from tidemark.operators.sequence import chunk_width, ordinal

    p = _predicted(spark, d).withColumn("error", r(F.abs(F.col("actual") - F.col("predicted"))))
    out = ordinal(p, ["search_id"], ["sequence"], "i", chunk_width(p, ["search_id"], "sequence"))
    return out.select("search_id", "candidate_id", (F.col("i") + 1).alias("round_no"), "error")


@query("e41_acquisition", f"{P0} SELECT candidate_id, round(predicted, 6) + 0.0 AS greedy_mean, round(predicted + 2 * sigma, 6) + 0.0 AS upper_confidence_bound FROM pr")
def e41(spark, d):
    p, s = F.col("predicted"), F.col("sigma")
    return _predicted(spark, d).select("candidate_id", r(G.acquisition("greedy_mean", p)).alias("greedy_mean"), r(G.acquisition("upper_confidence_bound", p, s)).alias("upper_confidence_bound"))


@query("e41_improvement_acquisitions")
def e41i(spark, d):
    """Expected and probable improvement need the normal CDF, which SQL lacks."""
    p, s, best = F.col("predicted"), F.col("sigma"), F.lit(-5.0)
    return _predicted(spark, d).select("candidate_id", r(G.acquisition("expected_improvement", p, s, best)).alias("ei"), r(G.acquisition("probability_of_improvement", p, s, best)).alias("pi"))


@query("e42_scored_candidates", f"{P0} SELECT candidate_id, round((predicted + 2 * sigma) * CASE WHEN feasible THEN 1 ELSE 0.5::DOUBLE END, 6) + 0.0 AS acquisition, 'optimistic bound at kappa=2' AS reason FROM pr")
def e42(spark, d):
    out = G.score_candidates(_predicted(spark, d), "upper_confidence_bound", None, feasibility=F.when(F.col("feasible"), 1.0).otherwise(0.5))
    return out.select("candidate_id", r("acquisition").alias("acquisition"), F.element_at(F.split("reason", "; "), -1).alias("reason"))


@query("e43_diverse_batch", f"""WITH RECURSIVE {EV}, {PRD}, o AS (SELECT *, row_number() OVER (ORDER BY predicted + 2 * sigma DESC, candidate_id) AS k FROM pr),
 f AS (SELECT k, [struct_pack(g := gain, b := bright, s := speed, y := style, p := flip, id := candidate_id)] AS kept FROM o WHERE k = 1 UNION ALL
 SELECT o.k, CASE WHEN len(kept) < 8 AND list_bool_and(list_transform(kept, lambda q: (abs(q.g - o.gain) / 20 + abs(q.b - o.bright) / 2 + abs(q.s - o.speed) / 6 + CASE WHEN q.y = o.style THEN 0 ELSE 1 END + CASE WHEN q.p = o.flip THEN 0 ELSE 1 END) / 5 >= 0.2))
  THEN list_append(kept, struct_pack(g := o.gain, b := o.bright, s := o.speed, y := o.style, p := o.flip, id := o.candidate_id)) ELSE kept END FROM f JOIN o ON o.k = f.k + 1 WHERE len(kept) < 8)
 SELECT unnest(list_transform(arg_max(kept, k), lambda q: q.id)) AS candidate_id FROM f""")
def e43(spark, d):
    p = _predicted(spark, d)
    picked = K.greedy_batch(p, "candidate_id", SPACE, G.acquisition("upper_confidence_bound", F.col("predicted"), F.col("sigma")), 8, 0.2)
    return p.where(F.col("candidate_id").isin([int(c["_id"]) for c in picked])).select("candidate_id")


SCL = """ob AS (SELECT candidate_id, unnest(['a', 'b']) AS o, unnest([predicted, bright]) AS p, unnest([sigma, sigma / 10]) AS s, unnest([0.7, 0.3])::DOUBLE AS w FROM pr), os AS (SELECT o, avg(p) AS m, stddev_pop(p) AS sd FROM ob GROUP BY 1)"""


@query("e44_scalarised_objectives", f"{P0}, {SCL} SELECT candidate_id, round(sum(w * (p - m) / sd), 6) + 0.0 AS predicted, round(sqrt(sum((w * s / sd) ** 2)), 6) AS sigma FROM ob JOIN os USING (o) GROUP BY 1")
def e44(spark, d):
    p = _flat(_predicted(spark, d))
    long = p.select("candidate_id", F.explode(F.array(
        F.struct(F.lit("a").alias("objective_id"), F.col("predicted"), F.col("sigma")),
        F.struct(F.lit("b").alias("objective_id"), F.col("bright").alias("predicted"), (F.col("sigma") / 10).alias("sigma")))).alias("c")).select("candidate_id", "c.*")
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "objective_id string, weight double")
    out = G.scalarised(durable(long), "candidate_id", weights)
    return out.select("candidate_id", r("predicted").alias("predicted"), r("sigma").alias("sigma"))


@query("e44_simplex_weights")
def e44w(spark, d):
    return G.simplex_weights(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ["a", "b", "c"], 5)


@query("e53_observed_front", f"{E0}, q AS (SELECT candidate_id, fitness, -wall_seconds AS w FROM ev WHERE usable) SELECT candidate_id, round(fitness, 6) + 0.0 AS fitness FROM q b WHERE NOT EXISTS (SELECT 1 FROM q a WHERE a.fitness >= b.fitness AND a.w >= b.w AND (a.fitness > b.fitness OR a.w > b.w))")
def e53(spark, d):
    ev = evaluations(spark, d).where("usable").select("candidate_id", "fitness", (-F.col("wall_seconds")).alias("w"))
    return PF.pareto_front(ev, "candidate_id", ["fitness", "w"]).select("candidate_id", r("fitness").alias("fitness"))


@query("j20_nearest_training_distance", f"{E0}, v AS (SELECT candidate_id, generation, cached, (bright + 1) / 2 AS a, flip AS b, (gain + 10) / 20 AS c, speed / 6 AS d, style AS s FROM ev), t AS (SELECT * FROM v WHERE cached) SELECT v.candidate_id, round(min(sqrt((v.a - t.a) ** 2 + (v.b - t.b) ** 2 + (v.c - t.c) ** 2 + (v.d - t.d) ** 2 + CASE WHEN v.s = t.s THEN 0 ELSE 2 END)), 8) AS distance FROM v, t WHERE NOT v.cached GROUP BY 1")
def j20(spark, d):
    enc, names = G.encode(evaluations(spark, d), SPACE)
    rows = durable(enc.select("candidate_id", "cached", G.vector_of(names).alias("v")))
    out = nearest_distance(rows.where("NOT cached"), rows.where("cached"), "candidate_id", "v")
    return out.withColumn("distance", r("distance", 8))


def _train(spark, d):
    enc, names = G.encode(evaluations(spark, d).where("usable"), SPACE)
    return durable(enc.select("candidate_id", "sequence", "fitness", *names)), names


@query("e37_ensemble_prediction")
def e37(spark, d):
    train, names = _train(spark, d)
    return G.predict(G.fit(train, names), train, names).select("candidate_id", r("predicted").alias("predicted"), r("sigma").alias("sigma"))


@query("e38_cross_validation")
def e38(spark, d):
    train, names = _train(spark, d)
    scored = durable(G.cross_validated(train, names, "candidate_id").select("candidate_id", "actual", "predicted").withColumn("scheme", F.lit("3_fold")))
    return G.error_metrics(scored, ["scheme"]).join(G.spearman(scored, ["scheme"], "actual", "predicted"), "scheme")


@query("e39_prefix_validation")
def e39(spark, d):
    train, names = _train(spark, d)
    scored = durable(G.prefix_validated(train, names, "sequence").select("candidate_id", "actual", "predicted").withColumn("scheme", F.lit("prefix")))
    return G.error_metrics(scored, ["scheme"]).join(G.spearman(scored, ["scheme"], "actual", "predicted"), "scheme")


@query("e40_family_comparison")
def e40(spark, d):
    train, names = _train(spark, d)
    return G.compare_families(train, names, "candidate_id")


@query("e52_pool_prediction")
def e52(spark, d):
    """Pool of new points: prediction, spread and distance to the training data."""
    train, names = _train(spark, d)
    fresh = K.random_candidates(spread_rows(table(spark, d, "part").select("p_partkey"), "p_partkey"), "p_partkey", SPACE, 29)
    pool, _ = G.encode(fresh, SPACE)
    pool = durable(pool.select("p_partkey", *names))
    scored = G.predict(G.fit(train, names), pool, names)
    far = nearest_distance(pool.select("p_partkey", G.vector_of(names).alias("v")), train.select(G.vector_of(names).alias("v")), "p_partkey", "v")
    return scored.join(far, "p_partkey").select("p_partkey", r("predicted").alias("predicted"), r("sigma").alias("sigma"), r("distance").alias("distance"))


@query("f03_acquisition_registry", f"{P0} SELECT candidate_id, round(predicted + 0.5 * sigma, 6) + 0.0 AS cautious FROM pr")
def f03(spark, d):
    entry = G.ACQUISITIONS.get("upper_confidence_bound")
    return _predicted(spark, d).select("candidate_id", r(entry.build(F.col("predicted"), F.col("sigma"), None, 0.5, 0.0)).alias("cautious"))


@query("f04_regressor_registry")
def f04(spark, d):
    train, names = _train(spark, d)
    G.REGRESSORS.require(["forest", "boosting"])
    model = G.fit(train, names, "boosting")
    return G.predict(model, train, names).select("candidate_id", r("predicted").alias("predicted"))
