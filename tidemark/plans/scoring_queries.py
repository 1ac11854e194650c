"""Experiment scoring: users as variants measured on objectives over their event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import METRICS
from tidemark.functions.scalar import display_normalise, margin_confidence, r, ratio, signed_normalise
from tidemark.operators import pareto as PF
from tidemark.operators import scoring as S
from tidemark.operators.panel import region_means
from tidemark.operators.ranks import exact_quantiles, ranked
from tidemark.operators.sequence import chunk_width
from tidemark.operators.scoring import Objective, Scope
from tidemark.operators.timejoin import bucket_width, stab_join
from tidemark.plans.content_queries import CV, DURATION, IV, SH, _events, _intervals
from tidemark.plans.registry import RT, SP, UM, query
from tidemark.sources.tables import ship_panel, table, unit_map

BASELINE = 0
OBJECTIVES = (
    Objective("m", "MEAN_RESPONSE", None, Scope(), "maximize", "min_max", 0.5),
    Objective("p", "PEAK_RESPONSE", ("purchase",), Scope("absolute", 100.0, 600.0), "minimize", "z_score", 0.3),
    Objective("s", "RESPONSE_STABILITY", ("click", "view"), Scope("normalized", 0.25, 0.75), "target", "robust", 0.4, 0.4, 0.5),
)
IDS = [o.objective_id for o in OBJECTIVES]


def _series(spark, d, objectives=OBJECTIVES):
    ev = _events(spark, d).withColumnRenamed("kind", "unit_id").withColumn("row_idx", F.col("idx"))
    width = chunk_width(ev, ["run_id"], "t")
    return ev, S.target_series(ev, objectives), ev.select("run_id").distinct().withColumn("duration", F.lit(DURATION)), width


def _scored(spark, d):
    ev, series, durations, width = _series(spark, d)
    windows = S.resolve_windows(ev, durations, OBJECTIVES)
    return S.score_experiment(series, windows, OBJECTIVES, BASELINE, width)


RAW = """rw AS (SELECT run_id, 'm' AS o, avg(value) AS v, count(*) AS n FROM cv GROUP BY 1
 UNION ALL SELECT run_id, 'p', max(value) FILTER (kind = 'purchase' AND t >= 100 AND t < 600), count(*) FILTER (kind = 'purchase' AND t >= 100 AND t < 600) FROM cv GROUP BY 1
 UNION ALL SELECT run_id, 's', stddev_samp(value) FILTER (kind IN ('click', 'view') AND t >= 180 AND t < 540), count(*) FILTER (kind IN ('click', 'view') AND t >= 180 AND t < 540) FROM cv GROUP BY 1),
 sx AS (SELECT o, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM rw GROUP BY 1),
 nm AS (SELECT run_id, o, v, CASE o WHEN 'm' THEN 0.5 WHEN 'p' THEN 0.3 ELSE 0.4 END / 1.2 AS w,
  CASE o WHEN 'm' THEN CASE WHEN hi - lo <= 0 AND v IS NOT NULL THEN 0.5 ELSE (v - lo) / (hi - lo) END WHEN 'p' THEN CASE WHEN sd <= 0 AND v IS NOT NULL THEN 0 ELSE (v - mu) / sd END
   ELSE CASE WHEN v IS NOT NULL THEN greatest(0, least(1, (v - p10) / (p90 - p10))) END END AS n FROM rw JOIN sx USING (o)),
 sc AS (SELECT run_id, o, v, n, w, CASE o WHEN 'm' THEN n WHEN 'p' THEN -n ELSE CASE WHEN n IS NOT NULL THEN greatest(0, 1 - abs(n - 0.4) / 0.5) END END AS s FROM nm),
 tt AS (SELECT run_id, CASE WHEN count(s) = 3 THEN sum(w * s) END AS total, CASE WHEN count(s) = 3 THEN sum(abs(w * s)) END AS mag, count(s) AS k FROM sc GROUP BY 1),
 rk AS (SELECT *, CASE WHEN total IS NOT NULL THEN row_number() OVER (PARTITION BY total IS NULL ORDER BY total DESC, run_id) END AS rank FROM tt)"""
SCORE = f"WITH {CV}, {RAW}"


@query("e19_score_experiment", f"""{SCORE} SELECT run_id, round(total, 6) + 0.0 AS total_score, k AS scored_objectives, rank,
 round(total - (SELECT total FROM tt WHERE run_id = 0), 6) + 0.0 AS baseline_delta,
 CASE WHEN abs((SELECT total FROM tt WHERE run_id = 0)) > 1e-9 THEN round((total - (SELECT total FROM tt WHERE run_id = 0)) / abs((SELECT total FROM tt WHERE run_id = 0)), 5) + 0.0 END AS baseline_relative FROM rk""")
def e19(spark, d):
    _, ranking = _scored(spark, d)
    return ranking.select("run_id", r("total_score").alias("total_score"), "scored_objectives", "rank",
                          r("baseline_delta").alias("baseline_delta"), r("baseline_relative", 5).alias("baseline_relative"))


@query("a25_normalised_scores", f"{SCORE} SELECT run_id, o AS objective_id, round(v, 6) AS raw_value, round(n, 6) + 0.0 AS normalized, round(s, 6) + 0.0 AS score FROM sc")
def a25(spark, d):
    scores, _ = _scored(spark, d)
    return scores.select("run_id", "objective_id", r("raw_value").alias("raw_value"), r("normalized").alias("normalized"), r("score").alias("score"))


@query("a25_all_strategies", f"""WITH {CV}, v AS (SELECT run_id, avg(value) AS v FROM cv GROUP BY 1), b AS (SELECT v AS base FROM v WHERE run_id = 0),
 x AS (SELECT run_id, v, base FROM v, b) SELECT run_id, 'none' AS objective_id, round(v, 8) AS normalized, round(-v, 8) AS score FROM x
 UNION ALL SELECT run_id, 'base', round((v - base) / abs(base), 8) + 0.0, round((v - base) / abs(base), 8) + 0.0 FROM x
 UNION ALL SELECT run_id, 'near', round(greatest(0, 1 - abs(v - 50) / 15), 8) + 0.0, round(greatest(0, 1 - abs(v - 50) / 15), 8) + 0.0 FROM x""")
def a25s(spark, d):
    objectives = (
        Objective("none", "MEAN_RESPONSE", direction="minimize", normalization="none"),
        Objective("base", "MEAN_RESPONSE", normalization="baseline"),
        Objective("near", "MEAN_RESPONSE", direction="target", normalization="target_distance", target_value=50.0, target_tolerance=15.0),
    )
    ev, series, durations, width = _series(spark, d, objectives)
    raw = S.evaluate(series, S.resolve_windows(ev, durations, objectives), objectives, width)
    out = S.normalise(raw, objectives, BASELINE)
    return out.select("run_id", "objective_id", r("normalized", 8).alias("normalized"), r("score", 8).alias("score"))


@query("a26_composite_contributions", f"{SCORE} SELECT sc.run_id, o AS objective_id, round(w * s, 6) + 0.0 AS contribution, round(abs(w * s) / mag, 6) AS fraction FROM sc JOIN tt USING (run_id) WHERE total IS NOT NULL")
def a26(spark, d):
    scores, ranking = _scored(spark, d)
    out = S.contribution_shares(scores, ranking)
    return out.select("run_id", "objective_id", r("contribution").alias("contribution"), r("fraction").alias("fraction"))


@query("a27_effective_weights", f"{SCORE} SELECT o AS objective_id, round(avg(abs(w * s) / mag), 6) AS effective_weight, round(any_value(w), 6) AS stated_weight, abs(avg(abs(w * s) / mag) - any_value(w)) > 0.15 AS drifts FROM sc JOIN tt USING (run_id) WHERE total IS NOT NULL AND mag > 0 GROUP BY 1")
def a27(spark, d):
    scores, ranking = _scored(spark, d)
    out = S.effective_weights(S.contribution_shares(scores, ranking))
    return out.select("objective_id", r("effective_weight").alias("effective_weight"), r("stated_weight").alias("stated_weight"), "drifts")


@query("p23_score_matrix", f"{SCORE} SELECT run_id, round(max(s) FILTER (o = 'm'), 6) + 0.0 AS m, round(max(s) FILTER (o = 'p'), 6) + 0.0 AS p, round(max(s) FILTER (o = 's'), 6) + 0.0 AS s FROM sc GROUP BY 1")
def p23(spark, d):
    scores, _ = _scored(spark, d)
    return S.score_matrix(scores, IDS).select("run_id", *[r(i).alias(i) for i in IDS])


@query("w17_variant_rank", f"{SCORE} SELECT run_id, rank FROM rk")
def w17(spark, d):
    return _scored(spark, d)[1].select("run_id", "rank")


@query("w17_rank_all_orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w17o(spark, d):
    """Ranks inside three large groups: range-partitioned, no group in one task."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranked(orders, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "rank", hot_rows=2000).select("o_orderkey", "rank")


@query("w20_weight_sweep", f"""{SCORE}, q AS (SELECT run_id, max(s) FILTER (o = 'm') AS m, max(s) FILTER (o = 'p') AS p, max(s) FILTER (o = 's') AS s FROM sc GROUP BY 1 HAVING count(s) = 3),
 g AS (SELECT i AS step, i / 20.0::DOUBLE AS w FROM range(21) AS g(i)),
 l AS (SELECT run_id, 'm' AS swept, step, w, w * m + (1 - w) * (0.3 / 0.7) * p + (1 - w) * (0.4 / 0.7) * s AS total FROM q, g
  UNION ALL SELECT run_id, 'p', step, w, w * p + (1 - w) * (0.5 / 0.9) * m + (1 - w) * (0.4 / 0.9) * s FROM q, g
  UNION ALL SELECT run_id, 's', step, w, w * s + (1 - w) * (0.5 / 0.8) * m + (1 - w) * (0.3 / 0.8) * p FROM q, g),
 k AS (SELECT *, row_number() OVER (PARTITION BY swept, step ORDER BY total DESC, run_id) AS k FROM l),
 b AS (SELECT swept, step, w, max(run_id) FILTER (k = 1) AS winner, max(total) FILTER (k = 1) - max(total) FILTER (k = 2) AS margin FROM k WHERE k <= 2 GROUP BY ALL)
 SELECT swept, round(w, 6) AS weight, winner, round(margin, 6) + 0.0 AS margin, coalesce(lag(winner) OVER (PARTITION BY swept ORDER BY step) <> winner, false) AS flip FROM b""")
def w20(spark, d):
    scores, _ = _scored(spark, d)
    out = S.sweep_weights(scores, OBJECTIVES)
    return out.select("swept", r("weight").alias("weight"), "winner", r("margin").alias("margin"), "flip")


DOM = """q AS (SELECT run_id, max(s) FILTER (o = 'm') AS m, max(s) FILTER (o = 'p') AS p, max(s) FILTER (o = 's') AS s FROM sc GROUP BY 1 HAVING count(s) = 3),
 fr AS (SELECT b.* FROM q b WHERE NOT EXISTS (SELECT 1 FROM q a WHERE a.m >= b.m AND a.p >= b.p AND a.s >= b.s AND (a.m > b.m OR a.p > b.p OR a.s > b.s)))"""


def _points(spark, d):
    scores, _ = _scored(spark, d)
    return S.score_matrix(scores, IDS)


@query("j12_pareto_front", f"{SCORE}, {DOM} SELECT run_id, round(m, 6) + 0.0 AS m, round(p, 6) + 0.0 AS p, round(s, 6) + 0.0 AS s FROM fr")
def j12(spark, d):
    front = PF.pareto_front(_points(spark, d), "run_id", IDS)
    return front.select("run_id", *[r(i).alias(i) for i in IDS])


@query("e20_pareto_analysis", f"""{SCORE}, {DOM} SELECT q.run_id, count(x.run_id) AS dominators, min(x.run_id) AS witness, count(x.run_id) = 0 AS on_front
 FROM q LEFT JOIN q x ON x.m >= q.m AND x.p >= q.p AND x.s >= q.s AND (x.m > q.m OR x.p > q.p OR x.s > q.s) GROUP BY q.run_id""")
def e20(spark, d):
    """Front membership, and how many variants beat each dominated one, with one of them."""
    points = _points(spark, d).dropna(subset=IDS)
    beaten = PF.dominators(points, points, "run_id", IDS)
    return points.join(beaten, "run_id", "left").select(
        "run_id", F.coalesce("dominators", F.lit(0)).alias("dominators"), "witness", F.col("witness").isNull().alias("on_front"))


@query("j12_part_front", """SELECT p_partkey, p_size, p_retailprice FROM part b WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_size >= b.p_size AND a.p_retailprice >= b.p_retailprice
 AND (a.p_size > b.p_size OR a.p_retailprice > b.p_retailprice))""")
def j12p(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return PF.pareto_front(parts, "p_partkey", ["p_size", "p_retailprice"])


BR = """br AS (SELECT p_brand, avg(p_size) AS a, avg(p_retailprice) AS b, count(*) + 0.0::DOUBLE AS c FROM part GROUP BY 1)"""


@query("k16_successive_fronts", f"""WITH RECURSIVE {BR}, dm AS (SELECT x.p_brand AS u, y.p_brand AS v FROM br x, br y WHERE x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND (x.a > y.a OR x.b > y.b OR x.c > y.c)),
 ch AS (SELECT p_brand, 0 AS front FROM br UNION SELECT v, front + 1 FROM ch JOIN dm ON ch.p_brand = dm.u) SELECT p_brand, max(front) AS front FROM ch GROUP BY 1""")
def k16(spark, d):
    brands = table(spark, d, "part").groupBy("p_brand").agg(
        F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    return PF.successive_fronts(brands, "p_brand", ["a", "b", "c"]).select("p_brand", "front")


@query("k16_take_by_front", """WITH RECURSIVE pt AS (SELECT o_custkey, sum(o_totalprice) AS a, count(*) + 0.0::DOUBLE AS b FROM orders GROUP BY 1),
 dm AS (SELECT x.o_custkey AS u, y.o_custkey AS v FROM pt x JOIN pt y ON x.a >= y.a AND x.b >= y.b AND (x.a > y.a OR x.b > y.b)),
 ch AS (SELECT o_custkey, 0 AS front FROM pt UNION SELECT v, front + 1 FROM ch JOIN dm ON ch.o_custkey = dm.u WHERE front < 12),
 fr AS (SELECT o_custkey, max(front) AS front FROM ch GROUP BY 1)
 SELECT o_custkey, front FROM fr JOIN pt USING (o_custkey) ORDER BY front, a DESC, o_custkey LIMIT 12""")
def k16_take(spark, d):
    """The best 12 customers front by front, larger spending first within the last front."""
    points = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    fronts = PF.successive_fronts(points, "o_custkey", ["a", "b"], want=12)
    return PF.take_by_front(fronts, "o_custkey", [F.desc("a")], 12).select("o_custkey", "front")


@query("e50_directional_dominance", f"""WITH {BR}, t AS (SELECT * FROM br WHERE p_brand = 'Brand#1'), v AS (SELECT br.p_brand, br.a AS x0, -br.b AS x1, -abs(br.c - 80) AS x2, t.a AS y0, -t.b AS y1, -abs(t.c - 80) AS y2 FROM br, t)
 SELECT p_brand, x0 >= y0 AND x1 >= y1 AND x2 >= y2 AND (x0 > y0 OR x1 > y1 OR x2 > y2) AS beats_reference FROM v""")
def e50(spark, d):
    brands = table(spark, d, "part").groupBy("p_brand").agg(
        F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    spec = [("a", "maximize", None), ("b", "minimize", None), ("c", "target", 80.0)]
    vec = brands.select("p_brand", PF.directional_vector(spec).alias("v"))
    ref = vec.where("p_brand = 'Brand#1'").select(F.lit(0).alias("k"), F.col("v").alias("ref"))
    return vec.withColumn("k", F.lit(0)).join(ref, "k").select("p_brand", PF.dominates(F.col("v"), F.col("ref")).alias("beats_reference"))


@query("e21_explanation", f"""{SCORE}, px AS (SELECT run_id, arg_max(t, value) AS pt, 'm' AS o FROM cv GROUP BY 1),
 z AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY s DESC NULLS LAST, rank) AS place FROM sc JOIN rk USING (run_id) WHERE rank <= 2),
 e AS (SELECT o AS objective_id, max(run_id) FILTER (place = 1) AS leader, max(run_id) FILTER (place = 2) AS runner_up, max(v) FILTER (place = 1) AS a, max(v) FILTER (place = 2) AS b,
  max(s) FILTER (place = 1) AS x, max(s) FILTER (place = 2) AS y FROM z GROUP BY 1)
 SELECT objective_id, leader, runner_up, round(x, 6) + 0.0 AS leader_score, round(y, 6) + 0.0 AS runner_up_score, round(greatest(a, b) - least(a, b), 6) AS difference,
 round((greatest(a, b) - least(a, b)) / abs(least(a, b)), 6) AS relative_difference, printf('%s: variant %d measured %.4f against %.4f for variant %d.', objective_id, leader, a, b, runner_up) AS statement FROM e""")
def e21(spark, d):
    scores, ranking = _scored(spark, d)
    out = S.explain_top_two(scores, ranking)
    return out.select("objective_id", "leader", "runner_up", r("leader_score").alias("leader_score"), r("runner_up_score").alias("runner_up_score"),
                      r("difference").alias("difference"), r("relative_difference").alias("relative_difference"), "statement")


@query("e21_context_at_peak", f"""{SCORE}, {SH}, {IV}, tp AS (SELECT run_id FROM rk WHERE rank <= 2), pk AS (SELECT run_id, arg_max(t, struct_pack(a := value, b := -t)) AS pt FROM cv JOIN tp USING (run_id) GROUP BY 1)
 SELECT pk.run_id, round(pt, 6) AS peak_t, string_agg(DISTINCT iv.kind, ',' ORDER BY iv.kind) AS kinds FROM pk JOIN iv ON iv.run_id = pk.run_id AND start_t <= pt AND pt < end_t GROUP BY ALL""")
def e21c(spark, d):
    scores, ranking = _scored(spark, d)
    peaks = scores.where("objective_id = 'm'").join(ranking.where("rank <= 2").select("run_id"), "run_id").select("run_id", F.col("peak_t").alias("pt"))
    iv = _intervals(_events(spark, d)).select("run_id", "kind", "start_t", "end_t")
    hit = stab_join(peaks, iv, ["run_id"], "pt", ("start_t", "end_t"), bucket_width(iv, "start_t", "end_t"))
    return hit.groupBy("run_id", r("pt").alias("peak_t")).agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


# Temporal scopes
SCOPES = (
    Objective("w1", "MEAN_RESPONSE", scope=Scope()),
    Objective("w2", "MEAN_RESPONSE", scope=Scope("absolute", 100.0, 600.0)),
    Objective("w3", "MEAN_RESPONSE", scope=Scope("normalized", 0.25, 0.75)),
    Objective("w4", "MEAN_RESPONSE", scope=Scope("event", event_type="audio", selection="last")),
    Objective("w5", "MEAN_RESPONSE", scope=Scope("event_relative", -2.0, 30.0, "speech", "longest")),
    Objective("w6", "MEAN_RESPONSE", scope=Scope("event", event_type="cta", selection="first", skip_empty=True)),
    Objective("w7", "MEAN_RESPONSE", scope=Scope("event", event_type="absent")),
)
WND = """sk AS (SELECT DISTINCT iv.run_id, iv.start_t, iv.end_t FROM iv JOIN cv ON cv.run_id = iv.run_id AND iv.kind = 'cta' AND cv.kind <> 'purchase' AND cv.t >= iv.start_t AND cv.t < iv.end_t),
 wn AS (SELECT run_id, 'w1' AS objective_id, min(t) AS a, max(t) + 1e-9 AS b FROM cv WHERE kind <> 'purchase' GROUP BY 1 UNION ALL SELECT run_id, 'w2', 100, 600 FROM du UNION ALL SELECT run_id, 'w3', 180, 540 FROM du
  UNION ALL SELECT du.run_id, 'w4', q.a, q.b FROM du LEFT JOIN (SELECT run_id, max(start_t) AS a, arg_max(end_t, start_t) AS b FROM iv WHERE kind = 'audio' GROUP BY 1) q USING (run_id)
  UNION ALL SELECT du.run_id, 'w5', q.a - 2, q.a + 30 FROM du LEFT JOIN (SELECT run_id, arg_min(start_t, struct_pack(x := start_t - end_t, y := start_t)) AS a FROM iv WHERE kind = 'speech' GROUP BY 1) q USING (run_id)
  UNION ALL SELECT du.run_id, 'w6', q.a, q.b FROM du LEFT JOIN (SELECT run_id, min(start_t) AS a, arg_min(end_t, start_t) AS b FROM sk GROUP BY 1) q USING (run_id)
  UNION ALL SELECT run_id, 'w7', NULL, NULL FROM du)"""


def _scope_windows(spark, d):
    ev = _events(spark, d)
    iv = _intervals(ev).select("run_id", F.col("kind").alias("event_type"), "start_t", "end_t")
    durations = ev.select("run_id").distinct().withColumn("duration", F.lit(DURATION))
    # Samples are the events that are not calls to action, so some of those hold no sample.
    samples = ev.where("kind <> 'purchase'")
    windows = S.resolve_windows(samples, durations, SCOPES, iv, bucket_width(iv, "start_t", "end_t"))
    return ev, samples, windows


@query("e09_temporal_scopes", f"WITH {CV}, {SH}, {IV}, {WND} SELECT run_id, objective_id, round(a, 6) AS start_t, round(b, 6) AS end_t, CASE WHEN a IS NULL THEN 'no such event' WHEN b <= a THEN 'empty window' END AS reason FROM wn")
def e09(spark, d):
    _, _, windows = _scope_windows(spark, d)
    return windows.select("run_id", "objective_id", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "reason")


@query("e18_evaluate_objectives", f"""WITH {CV}, {SH}, {IV}, {WND}
 SELECT wn.run_id, objective_id, count(value) AS samples, round(avg(value), 8) AS raw_value, count(value) > 0 AS valid,
 CASE WHEN any_value(a) IS NULL THEN 'no such event' WHEN any_value(b) <= any_value(a) THEN 'empty window' WHEN count(value) = 0 THEN 'no samples in window' END AS reason
 FROM wn LEFT JOIN cv ON cv.run_id = wn.run_id AND cv.kind <> 'purchase' AND t >= a AND t < b GROUP BY ALL""")
def e18(spark, d):
    _, samples, windows = _scope_windows(spark, d)
    series = S.target_series(samples.withColumnRenamed("kind", "unit_id").withColumn("row_idx", F.col("idx")), SCOPES)
    out = S.evaluate(series, windows, SCOPES)
    return out.select("run_id", "objective_id", "samples", r("raw_value", 8).alias("raw_value"), "valid", "reason")


@query("k15_occurrence_choice", f"WITH {CV}, {SH}, {IV} SELECT run_id, kind, round(arg_min(start_t, struct_pack(x := start_t - end_t, y := start_t)), 6) AS start_t FROM iv GROUP BY ALL")
def k15(spark, d):
    iv = _intervals(_events(spark, d))
    return S.select_occurrence(iv, ["run_id", "kind"], "longest").select("run_id", "kind", r("start_t").alias("start_t"))


# One query per metric, all on the same whole-run window.
def _metric_query(name, metric, digits):
    def run(spark, d):
        objectives = (Objective("o", metric),)
        ev, series, durations, width = _series(spark, d, objectives)
        out = S.evaluate(series, S.resolve_windows(ev, durations, objectives), objectives, width)
        cols = ["run_id", r("raw_value", digits).alias("raw_value")]
        return out.select(*cols, *([r("peak_t").alias("peak_t")] if metric == "PEAK_RESPONSE" else []))

    return run


query("e11_mean_response", f"WITH {CV} SELECT run_id, round(avg(value), 8) AS raw_value FROM cv GROUP BY 1")(_metric_query("e11", "MEAN_RESPONSE", 8))
query("e12_peak_response", f"WITH {CV} SELECT run_id, max(value) AS raw_value, round(arg_max(t, struct_pack(a := value, b := -t)), 6) AS peak_t FROM cv GROUP BY 1")(_metric_query("e12", "PEAK_RESPONSE", 6))
query("e13_integrated_response", f"WITH {CV}, p AS (SELECT run_id, value, t, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY t)) SELECT run_id, round(CASE WHEN count(*) >= 2 THEN sum((value + pv) / 2 * (t - pt)) END, 5) AS raw_value FROM p GROUP BY 1")(_metric_query("e13", "INTEGRATED_RESPONSE", 5))
query("e14_response_stability", f"WITH {CV} SELECT run_id, round(stddev_samp(value), 6) AS raw_value FROM cv GROUP BY 1")(_metric_query("e14", "RESPONSE_STABILITY", 6))
query("e15_temporal_change", f"WITH {CV}, p AS (SELECT run_id, abs(value - lag(value) OVER (PARTITION BY run_id ORDER BY t)) AS s FROM cv) SELECT run_id, round(avg(s), 8) AS raw_value FROM p GROUP BY 1")(_metric_query("e15", "TEMPORAL_CHANGE_MAGNITUDE", 8))


@query("e16_pattern_similarity", f"""WITH {SP}, {UM}, {RT}, n AS (SELECT count(DISTINCT region_id) AS n FROM rt), f AS (SELECT run_id, row_idx FROM rt GROUP BY ALL HAVING count(*) = (SELECT n FROM n)),
 m AS (SELECT run_id, region_id, avg(value) AS m FROM rt JOIN f USING (run_id, row_idx) GROUP BY ALL), b AS (SELECT s_nationkey AS region_id, avg(s_acctbal) AS b FROM supplier GROUP BY 1)
 SELECT run_id, round(sum(m * b) / (sqrt(sum(m * m)) * sqrt(sum(b * b))), 8) AS raw_value, count(*) AS compared_units FROM m JOIN b USING (region_id) GROUP BY 1""")
def e16(spark, d):
    regions = region_means(ship_panel(spark, d), unit_map(spark, d)).withColumnRenamed("region_id", "unit_id")
    ref = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit_id")).agg(F.avg("s_acctbal").alias("ref_value"))
    return S.pattern_similarity(regions, ref).withColumn("raw_value", r("raw_value", 8))


@query("e17_divergence_from_baseline", f"""WITH {CV}, i AS (SELECT run_id, kind, floor(t / 24) AS day, avg(value) AS v FROM cv GROUP BY ALL), f AS (SELECT run_id, day, avg(v) AS value FROM i GROUP BY ALL),
 w AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY day) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM f WHERE day >= 2 AND day < 12),
 b AS (SELECT i, value AS base, n AS bn FROM w WHERE run_id = 0)
 SELECT w.run_id, CASE WHEN any_value(n) = (SELECT max(bn) FROM b) THEN round(sqrt(avg((value - base) * (value - base))), 6) END AS raw_value, CASE WHEN any_value(n) <> (SELECT max(bn) FROM b) THEN 'window lengths differ' END AS reason
 FROM w LEFT JOIN b USING (i) GROUP BY 1""")
def e17(spark, d):
    objectives = (Objective("o", "DIVERGENCE_FROM_BASELINE", scope=Scope("absolute", 2.0, 12.0)),)
    ev = _events(spark, d)
    daily = ev.groupBy("run_id", F.col("kind").alias("unit_id"), F.floor(F.col("t") / 24).alias("row_idx")).agg(F.avg("value").alias("value")).withColumn("t", F.col("row_idx").cast("double"))
    series = S.target_series(daily, objectives)
    durations = ev.select("run_id").distinct().withColumn("duration", F.lit(30.0))
    inside = S.windowed(series, S.resolve_windows(daily, durations, objectives))
    out = S.divergence_from_baseline(inside, BASELINE)
    return out.select("run_id", r("raw_value").alias("raw_value"), "reason")


@query("e19_reference_metrics", f"""WITH {CV}, i AS (SELECT run_id, kind, floor(t / 24) AS day, avg(value) AS v FROM cv GROUP BY ALL), f AS (SELECT run_id, day, avg(v) AS value FROM i GROUP BY ALL),
 w AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY day) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM f WHERE day >= 2 AND day < 12),
 b AS (SELECT i, value AS base, n AS bn FROM w WHERE run_id = 0),
 dv AS (SELECT w.run_id, any_value(n) AS samples, CASE WHEN any_value(n) = (SELECT max(bn) FROM b) THEN round(sqrt(avg((value - base) * (value - base))), 6) END AS v,
  CASE WHEN any_value(n) <> (SELECT max(bn) FROM b) THEN 'window lengths differ' END AS why FROM w LEFT JOIN b USING (i) GROUP BY 1),
 p AS (SELECT * FROM i WHERE day >= 2 AND day < 12), full_rows AS (SELECT run_id, day FROM p GROUP BY ALL HAVING count(v) = (SELECT count(DISTINCT kind) FROM p)),
 m AS (SELECT run_id, kind, avg(v) AS m FROM p JOIN full_rows USING (run_id, day) GROUP BY ALL), rf AS (SELECT event_type AS kind, count(*) / 100.0 AS b FROM events GROUP BY 1),
 sm AS (SELECT run_id, round(sum(m * b) / (sqrt(sum(m * m)) * sqrt(sum(b * b))), 6) AS v FROM m JOIN rf USING (kind) GROUP BY 1),
 us AS (SELECT DISTINCT run_id FROM cv)
 SELECT run_id, 'd' AS objective_id, v AS raw_value, CASE WHEN samples IS NULL THEN 'no samples in window' ELSE why END AS reason FROM us LEFT JOIN dv USING (run_id)
 UNION ALL SELECT us.run_id, 's', sm.v, CASE WHEN samples IS NULL THEN 'no samples in window' WHEN sm.v IS NULL THEN 'too few samples' END FROM us LEFT JOIN dv USING (run_id) LEFT JOIN sm ON sm.run_id = us.run_id""")
def e19_reference(spark, d):
    """Both metrics with a second input, scored beside each other."""
    scope = Scope("absolute", 2.0, 12.0)
    objectives = (Objective("d", "DIVERGENCE_FROM_BASELINE", scope=scope), Objective("s", "PATTERN_SIMILARITY_TO_REFERENCE", scope=scope))
    ev = _events(spark, d)
    daily = ev.groupBy("run_id", F.col("kind").alias("unit_id"), F.floor(F.col("t") / 24).alias("row_idx")).agg(F.avg("value").alias("value")).withColumn("t", F.col("row_idx").cast("double"))
    durations = ev.select("run_id").distinct().withColumn("duration", F.lit(30.0))
    reference = table(spark, d, "events").groupBy(F.col("event_type").alias("unit_id")).agg((F.count("*") / 100.0).alias("ref_value"))
    windows = S.resolve_windows(daily, durations, objectives)
    scores, _ = S.score_experiment(S.target_series(daily, objectives), windows, objectives, BASELINE, panel=daily, reference=reference)
    return scores.select("run_id", "objective_id", r("raw_value").alias("raw_value"), "reason")


@query("j11_ordinal_pairing", f"""WITH {CV}, w AS (SELECT run_id, idx, value, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS i FROM cv), b AS (SELECT i, value AS base FROM w WHERE run_id = 0)
 SELECT w.run_id, count(base) AS paired, round(avg(value - base), 6) + 0.0 AS mean_difference FROM w LEFT JOIN b USING (i) GROUP BY 1""")
def j11(spark, d):
    from tidemark.operators.sequence import ordinal

    ev = _events(spark, d)
    placed = ordinal(ev, ["run_id"], ["t"], "i", chunk_width(ev, ["run_id"], "t"))
    base = placed.where("run_id = 0").select("i", F.col("value").alias("base"))
    return placed.join(base, "i", "left").groupBy("run_id").agg(
        F.count("base").alias("paired"), r(F.avg(F.col("value") - F.col("base"))).alias("mean_difference"))


@query("w16_sample_contributions", f"""WITH {CV}, n AS (SELECT run_id, count(*) AS n, arg_max(t, struct_pack(a := value, b := -t)) AS pt FROM cv GROUP BY 1),
 p AS (SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt, lead(value) OVER w AS nv, lead(t) OVER w AS nt FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY t))
 SELECT run_id, idx, 'a' AS objective_id, round(value / n, 8) AS contribution FROM cv JOIN n USING (run_id)
 UNION ALL SELECT run_id, idx, 'b', CASE WHEN t = pt THEN value ELSE 0 END FROM cv JOIN n USING (run_id)
 UNION ALL SELECT run_id, idx, 'c', round((coalesce((value + pv) / 2 * (t - pt), 0) + coalesce((value + nv) / 2 * (nt - t), 0)) / 2, 6) FROM p""")
def w16(spark, d):
    objectives = (Objective("a", "MEAN_RESPONSE"), Objective("b", "PEAK_RESPONSE"), Objective("c", "INTEGRATED_RESPONSE"))
    ev, series, durations, width = _series(spark, d, objectives)
    out = S.contributions(series, S.resolve_windows(ev, durations, objectives), objectives, width)
    c = F.col("contribution")
    return out.select("run_id", F.col("row_idx").alias("idx"), "objective_id",
                      F.when(F.col("objective_id") == "a", r(c, 8)).when(F.col("objective_id") == "c", r(c)).otherwise(c).alias("contribution"))


@query("w16_contribution_check", f"WITH {CV} SELECT run_id, o AS objective_id, true AS sums_to_metric FROM (SELECT DISTINCT run_id FROM cv), (SELECT unnest(['a', 'b', 'c']) AS o)")
def w16c(spark, d):
    objectives = (Objective("a", "MEAN_RESPONSE"), Objective("b", "PEAK_RESPONSE"), Objective("c", "INTEGRATED_RESPONSE"))
    ev, series, durations, width = _series(spark, d, objectives)
    windows = S.resolve_windows(ev, durations, objectives)
    parts = S.contributions(series, windows, objectives, width).groupBy("run_id", "objective_id").agg(F.sum("contribution").alias("s"))
    raw = S.evaluate(series, windows, objectives, width)
    close = F.abs(F.col("s") - F.col("raw_value")) <= 1e-9 + 1e-6 * F.abs("raw_value")
    return parts.join(raw, ["run_id", "objective_id"]).select("run_id", "objective_id", close.alias("sums_to_metric"))


@query("a28_regional_contribution", f"""WITH {SP}, {UM}, m AS (SELECT run_id, region_id, avg(value) AS v, count(DISTINCT unit_id) AS units FROM sp JOIN um USING (unit_id) WHERE region_id IS NOT NULL AND t >= 12 AND t < 36 GROUP BY ALL)
 SELECT run_id, region_id, round(v, 6) AS mean_value, units, round(abs(v) / sum(abs(v)) OVER (PARTITION BY run_id), 8) AS share FROM m""")
def a28(spark, d):
    out = S.regional_contribution(ship_panel(spark, d), unit_map(spark, d), 12.0, 36.0)
    return out.select("run_id", "region_id", r("mean_value").alias("mean_value"), "units", r("share", 8).alias("share"))


@query("e10_spatial_targets", f"""WITH {SP}, {UM}, g AS (SELECT 'whole' AS target, unit_id FROM um WHERE NOT excluded UNION ALL SELECT 'region_3', unit_id FROM um WHERE region_id = 3 UNION ALL SELECT 'network_1', unit_id FROM um WHERE network_id = 1
 UNION ALL SELECT 'left', unit_id FROM um WHERE NOT excluded AND hemisphere = 'left' UNION ALL SELECT 'explicit', unit_id FROM um WHERE unit_id IN (1, 5, 9))
 SELECT run_id, target, row_idx, round(avg(value), 6) AS value, count(*) AS units FROM sp JOIN g USING (unit_id) GROUP BY ALL""")
def e10(spark, d):
    um = unit_map(spark, d)
    kinds = {
        "whole": ~F.col("excluded"), "region_3": F.col("region_id") == 3, "network_1": F.col("network_id") == 1,
        "left": ~F.col("excluded") & (F.col("hemisphere") == "left"), "explicit": F.col("unit_id").isin(1, 5, 9),
    }
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]))
    targets = um.select("unit_id", F.explode(tags).alias("objective_id"))
    out = S.region_target_series(ship_panel(spark, d), targets)
    return out.select("run_id", F.col("objective_id").alias("target"), "row_idx", r("value").alias("value"), "units")


@query("x13_direction_folding", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN p_retailprice WHEN 'Brand#2' THEN -p_retailprice ELSE -abs(p_retailprice - 950) END AS fitness FROM part")
def x13(spark, d):
    from tidemark.functions.scalar import directional

    direction = F.when(F.col("p_brand") == "Brand#1", "maximize").when(F.col("p_brand") == "Brand#2", "minimize").otherwise("target")
    return table(spark, d, "part").select("p_partkey", directional(direction, F.col("p_retailprice"), F.lit(950.0)).alias("fitness"))


@query("x14_direction_to_score", f"{SCORE} SELECT run_id, round(n, 6) + 0.0 AS normalized, round(CASE WHEN n IS NOT NULL THEN greatest(0, 1 - abs(n - 0.4) / 0.5) END, 6) AS score FROM nm WHERE o = 's'")
def x14(spark, d):
    scores, _ = _scored(spark, d)
    return scores.where("objective_id = 's'").select("run_id", r("normalized").alias("normalized"), r("score").alias("score"))


@query("x16_guarded_ratio", "SELECT c_custkey, CASE WHEN abs(c_acctbal) > 1e-9 THEN round(c_nationkey / c_acctbal, 8) + 0.0 END AS ratio FROM customer")
def x16(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(ratio("c_nationkey", "c_acctbal"), 8).alias("ratio"))


@query("x17_margin_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount - 0.01 <= 0.018 THEN 0 ELSE round(least(1, (l_discount - 0.01 - 0.018) / (0.06 - 0.018)), 4) END::DOUBLE AS confidence FROM lineitem")
def x17(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", margin_confidence(F.col("l_discount") - 0.01).alias("confidence"))


@query("x18_display_normalisation", """WITH q AS (SELECT quantile_cont(s_acctbal, 0.01) AS lo, quantile_cont(s_acctbal, 0.99) AS hi, greatest(abs(quantile_cont(s_acctbal, 0.01)), abs(quantile_cont(s_acctbal, 0.99))) AS e FROM supplier)
 SELECT s_suppkey, round(greatest(0, least(1, (s_acctbal - lo) / (hi - lo))), 6) AS display, round(greatest(-1, least(1, s_acctbal / e)), 6) + 0.0 AS signed FROM supplier, q""")
def x18(spark, d):
    s = table(spark, d, "supplier").withColumn("_k", F.lit(0))
    q = exact_quantiles(s, ["_k"], "s_acctbal", {"lo": 0.01, "hi": 0.99}, hot_rows=0)
    extent = F.greatest(F.abs("lo"), F.abs("hi"))
    return s.join(q, "_k").select("s_suppkey", r(display_normalise(F.col("s_acctbal"), F.col("lo"), F.col("hi"))).alias("display"),
                                  r(signed_normalise(F.col("s_acctbal"), extent)).alias("signed"))


@query("f01_metric_registry", f"""WITH {CV} SELECT run_id, round(avg(value), 8) AS mean_response, max(value) AS peak_response, round(stddev_samp(value), 6) AS response_stability FROM cv GROUP BY 1""")
def f01(spark, d):
    names = {"MEAN_RESPONSE": 8, "PEAK_RESPONSE": 6, "RESPONSE_STABILITY": 6}
    METRICS.require(list(names))
    return _events(spark, d).groupBy("run_id").agg(*[r(METRICS.get(n).build(), k).alias(n.lower()) for n, k in names.items()])


@query("a43_objective_conflict", f"{SCORE} SELECT count(DISTINCT w) > 1 AS conflict FROM (SELECT o, arg_max(run_id, struct_pack(a := s, b := -run_id)) AS w FROM sc WHERE s IS NOT NULL GROUP BY 1)")
def a43(spark, d):
    scores, _ = _scored(spark, d)
    best = scores.where("score IS NOT NULL").groupBy("objective_id").agg(F.max_by("run_id", F.struct("score", -F.col("run_id"))).alias("w"))
    return best.agg((F.countDistinct("w") > 1).alias("conflict"))


