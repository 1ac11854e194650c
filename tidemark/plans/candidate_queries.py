"""Candidate search over parts: each part is one evaluated candidate of its type's search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import r
from tidemark.operators import candidates as K
from tidemark.operators.candidates import Guardrail, Parameter
from tidemark.operators.ranks import ranked
from tidemark.plans.registry import query
from tidemark.session import spread_rows
from tidemark.sources.tables import table

SPACE = (
    Parameter("gain", "continuous", -10.0, 10.0, resolution=0.1, modality="audio"),
    Parameter("bright", "continuous", -1.0, 1.0, resolution=0.01, modality="visual"),
    Parameter("speed", "integer", 0, 6, modality="pace"),
    Parameter("style", "categorical", choices=(0.0, 1.0, 2.0), modality="visual"),
    Parameter("flip", "boolean", choices=(0.0, 1.0), modality="visual"),
)
EV = """ev AS (SELECT candidate_id, search_id, sequence, generation, gain, bright, speed, style, flip, status, duration_change, wall_seconds, cached,
  CASE WHEN status = 'evaluated' THEN -(gain - 3) * (gain - 3) - 10 * (bright - 0.4) * (bright - 0.4) + (candidate_id % 7) / 10.0::DOUBLE END AS fitness, abs(bright) <= 0.9 AS feasible,
  status = 'evaluated' AS usable, status = 'evaluated' AND abs(bright) <= 0.9 AS eligible
 FROM (SELECT p_partkey AS candidate_id, p_type AS search_id, p_partkey AS sequence, CAST(p_partkey // 200 AS INTEGER) AS generation,
  round(round_even(greatest(-10, least(10, (p_size - 25.5::DOUBLE) / 25.5 * 10)) / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 12) AS gain, round(round_even(greatest(-1, least(1, (p_retailprice - 950) / 50)) / 0.01::DOUBLE, 0) * 0.01::DOUBLE, 12) AS bright,
  (p_size % 7)::DOUBLE AS speed, (p_partkey % 3)::DOUBLE AS style, (p_size % 2)::DOUBLE AS flip,
  CASE WHEN p_partkey % 17 = 0 THEN 'evaluation_failed' WHEN p_partkey % 19 = 0 THEN 'not_measurable' ELSE 'evaluated' END AS status, (p_size - 25) / 10.0::DOUBLE AS duration_change, p_size * 1.5::DOUBLE AS wall_seconds, p_partkey % 5 = 0 AS cached FROM part))"""
E0 = f"WITH {EV}"


def evaluations(spark, d):
    p = spread_rows(table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice"), "p_partkey")
    size, key = F.col("p_size"), F.col("p_partkey")
    cols = {
        "gain": K.clamp(SPACE[0], (size - F.lit(25.5)) / 25.5 * 10),
        "bright": K.clamp(SPACE[1], (F.col("p_retailprice") - 950) / 50),
        "speed": (size % 7).cast("double"), "style": (key % 3).cast("double"), "flip": (size % 2).cast("double"),
    }
    status = F.when(key % 17 == 0, "evaluation_failed").when(key % 19 == 0, "not_measurable").otherwise("evaluated")
    base = p.select(
        key.alias("candidate_id"), F.col("p_type").alias("search_id"), key.alias("sequence"), F.floor(key / 200).cast("int").alias("generation"),
        K.value_map(cols).alias("values"), status.alias("status"), ((size - 25) / 10.0).alias("duration_change"), (size * 1.5).alias("wall_seconds"), (key % 5 == 0).alias("cached"))
    g, b = F.element_at("values", F.lit("gain")), F.element_at("values", F.lit("bright"))
    fit = -(g - 3) * (g - 3) - 10 * (b - 0.4) * (b - 0.4) + (F.col("candidate_id") % 7) / F.lit(10.0)
    out = base.withColumn("fitness", F.when(F.col("status") == "evaluated", fit)).withColumn("feasible", F.abs(b) <= 0.9)
    return K.with_state(out)


def _flat(df):
    return df.select("*", *[K.get(p).alias(p.name) for p in SPACE])


@query("x12_quantise_and_clamp", f"{E0} SELECT candidate_id, gain, bright FROM ev")
def x12(spark, d):
    return _flat(evaluations(spark, d)).select("candidate_id", "gain", "bright")


@query("x11_mixed_distance", f"{E0}, b AS (SELECT * FROM ev WHERE candidate_id = 7) SELECT ev.candidate_id, round((abs(ev.gain - b.gain) / 20 + abs(ev.bright - b.bright) / 2 + abs(ev.speed - b.speed) / 6 + CASE WHEN ev.style = b.style THEN 0 ELSE 1 END + CASE WHEN ev.flip = b.flip THEN 0 ELSE 1 END) / 5, 8) AS distance FROM ev, b")
def x11(spark, d):
    ev = evaluations(spark, d)
    anchor = ev.where("candidate_id = 7").select(F.lit(0).alias("k"), F.col("values").alias("anchor"))
    return ev.withColumn("k", F.lit(0)).join(anchor, "k").select("candidate_id", r(K.distance(SPACE, F.col("values"), F.col("anchor")), 8).alias("distance"))


@query("x15_fingerprint", f"{E0} SELECT candidate_id, sha256(printf('bright=%.6f;flip=%.6f;gain=%.6f;speed=%.6f;style=%.6f', bright + 0.0, flip, gain + 0.0, speed, style)) AS fp FROM ev")
def x15(spark, d):
    return evaluations(spark, d).select("candidate_id", K.fingerprint(SPACE).alias("fp"))


@query("p16_guardrails", f"""{E0} SELECT candidate_id, array_to_string(list_filter([CASE WHEN gain < -8 THEN 'g_floor' END, CASE WHEN fitness IS NOT NULL AND bright > 0.8 THEN 'b_ceiling' END, CASE WHEN (5 - speed) / 5 > 0.6 + 1e-12 THEN 's_drop' END, CASE WHEN abs(duration_change) > 2 + 1e-9 THEN 'duration' END], lambda x: x IS NOT NULL), ',') AS violations,
 CASE WHEN fitness IS NULL THEN 'b_ceiling' ELSE '' END AS unchecked FROM ev""")
def p16(spark, d):
    rails = (Guardrail("g_floor", "floor", -8.0, "gain"), Guardrail("b_ceiling", "ceiling", 0.8, "bright"),
             Guardrail("s_drop", "max_relative_drop", 0.6, "speed"), Guardrail("duration", "max_duration_change", 2.0))
    ev = evaluations(spark, d)
    raw = F.map_filter("values", lambda k, v: (k != "bright") | F.col("fitness").isNotNull())
    out = K.check_guardrails(ev.drop("feasible").withColumn("raw_objectives", raw), rails, {"speed": 5.0})
    return out.select("candidate_id", F.array_join("violations", ",").alias("violations"), F.array_join("unchecked", ",").alias("unchecked"))


@query("p17_frozen_modality", f"{E0} SELECT candidate_id, array_to_string(list_filter([CASE WHEN gain <> 0 THEN 'gain' END, CASE WHEN speed <> 0 THEN 'speed' END], lambda x: x IS NOT NULL), ',') AS broken FROM ev")
def p17(spark, d):
    return evaluations(spark, d).select("candidate_id", F.array_join(K.frozen_violations(SPACE, ("audio", "pace")), ",").alias("broken"))


@query("p20_in_domain", "SELECT p_partkey AS candidate_id, CASE WHEN p_size / 4.0 > 10 + 1e-12 THEN 'gain' ELSE '' END AS outside FROM part")
def p20(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    values = K.value_map({"gain": size / 4.0, "bright": F.lit(0.5), "speed": size % 7, "style": key % 3, "flip": size % 2})
    return table(spark, d, "part").select(key.alias("candidate_id"), values.alias("values")).select("candidate_id", F.array_join(K.violations(SPACE), ",").alias("outside"))


@query("p21_neutral_points", f"{E0} SELECT count(*) AS candidates, count(*) FILTER (gain = 0 AND speed = 0 AND style = 0) AS neutral FROM ev")
def p21(spark, d):
    some = (SPACE[0], SPACE[2], SPACE[3])
    return evaluations(spark, d).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(K.is_neutral(some), 1)).alias("neutral"))


@query("p27_consistent_names", "SELECT p_type AS search_id, true AS consistent FROM part GROUP BY 1")
def p27(spark, d):
    names = F.array_join(F.array_sort(F.map_keys("values")), ",")
    return evaluations(spark, d).groupBy("search_id").agg((F.countDistinct(names) == 1).alias("consistent"))


@query("u04_key_sets", "SELECT p_partkey AS candidate_id, CASE WHEN p_size % 3 = 0 THEN 'flip' ELSE '' END AS missing, CASE WHEN p_size % 4 = 0 THEN 'zoom' ELSE '' END AS unknown FROM part")
def u04(spark, d):
    ev = evaluations(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"), "p_size"), "candidate_id")
    fewer = F.map_filter("values", lambda k, v: (k != "flip") | (F.col("p_size") % 3 != 0))
    extra = F.when(F.col("p_size") % 4 == 0, F.map_concat(fewer, F.create_map(F.lit("zoom"), F.lit(1.0)))).otherwise(fewer)
    missing, unknown = K.key_problems(SPACE, "values")
    return ev.withColumn("values", extra).select("candidate_id", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"))


@query("p28_candidate_states", f"{E0}, b AS (SELECT search_id, max(fitness) AS bf FROM ev WHERE eligible GROUP BY 1) SELECT candidate_id, usable, eligible, coalesce(fitness - bf > -5, false) AS beats_by_margin, coalesce(abs(bf - fitness) <= 1, false) AS within_noise FROM ev LEFT JOIN b USING (search_id)")
def p28(spark, d):
    ev = evaluations(spark, d)
    j = ev.join(K.best_of(ev, ["search_id"]), "search_id", "left")
    gain = F.col("fitness") - F.col("best_fitness")
    return j.select("candidate_id", "usable", "eligible", F.coalesce(gain > -5, F.lit(False)).alias("beats_by_margin"), F.coalesce(F.abs(gain) <= 1, F.lit(False)).alias("within_noise"))


BEST = """be AS (SELECT search_id, arg_max(candidate_id, struct_pack(a := fitness, b := -candidate_id)) AS best_id, max(fitness) AS best_fitness FROM ev WHERE eligible GROUP BY 1)"""


@query("k07_best_candidates", f"{E0}, {BEST}, bi AS (SELECT search_id, arg_max(candidate_id, struct_pack(a := fitness, b := -candidate_id)) AS best_infeasible FROM ev WHERE usable AND NOT feasible GROUP BY 1) SELECT search_id, best_id, round(best_fitness, 6) + 0.0 AS best_fitness, best_infeasible FROM be LEFT JOIN bi USING (search_id)")
def k07(spark, d):
    ev = evaluations(spark, d)
    bad = K.best_of(ev, ["search_id"], feasible=False).select("search_id", F.col("best_id").alias("best_infeasible"))
    return K.best_of(ev, ["search_id"]).join(bad, "search_id", "left").select("search_id", "best_id", r("best_fitness").alias("best_fitness"), "best_infeasible")


@query("k08_tied_with_best", f"{E0}, {BEST} SELECT search_id, candidate_id FROM ev JOIN be USING (search_id) WHERE usable AND candidate_id <> best_id AND abs(best_fitness - fitness) <= 2")
def k08(spark, d):
    return K.tied_with_best(evaluations(spark, d), ["search_id"], 2.0).select("search_id", "candidate_id")


POP = "rr AS (SELECT search_id, candidate_id, row_number() OVER (PARTITION BY search_id ORDER BY fitness DESC, candidate_id) AS rank, count(*) OVER (PARTITION BY search_id) AS n FROM ev WHERE eligible), nn AS (SELECT search_id, candidate_id, CASE WHEN usable THEN 'guardrail' WHEN status = 'evaluation_failed' THEN 'failed' ELSE 'not_measurable' END AS reason FROM ev WHERE NOT eligible)"


@query("k09_population", f"{E0}, {POP} SELECT search_id, candidate_id, CAST(rank AS INTEGER) AS rank, n AS \"of\", CASE WHEN rank <= 20 THEN 'kept' ELSE 'outside_beam' END AS reason FROM rr UNION ALL SELECT search_id, candidate_id, NULL, NULL, reason FROM nn")
def k09(spark, d):
    return K.population(evaluations(spark, d), ["search_id"], keep=20)


@query("k10_successive_halving", f"{E0}, {POP} SELECT search_id, candidate_id, CAST(rank AS INTEGER) AS rank, n AS \"of\", CASE WHEN rank <= greatest(1, floor(n * 0.5)) THEN 'kept' ELSE 'halved' END AS reason FROM rr UNION ALL SELECT search_id, candidate_id, NULL, NULL, reason FROM nn")
def k10(spark, d):
    return K.population(evaluations(spark, d), ["search_id"], fraction=0.5)


@query("k18_rank_eligible", f"{E0}, {POP} SELECT search_id, candidate_id, rank FROM rr")
def k18(spark, d):
    return ranked(evaluations(spark, d).where("eligible"), ["search_id"], [F.col("fitness").desc(), F.col("candidate_id").asc()], "rank", hot_rows=100).select("search_id", "candidate_id", "rank")


@query("k17_beam", f"{E0}, q AS (SELECT search_id, gain, bright, max(fitness) AS f FROM ev WHERE eligible GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY f DESC, gain, bright) AS rank FROM q) SELECT search_id, gain, bright, rank, rank <= 5 AS in_beam FROM k")
def k17(spark, d):
    ev = _flat(evaluations(spark, d)).where("eligible").groupBy("search_id", "gain", "bright").agg(F.max("fitness").alias("f"))
    out = ranked(ev, ["search_id"], [F.col("f").desc(), F.col("gain").asc(), F.col("bright").asc()])
    return out.select("search_id", "gain", "bright", "rank", (F.col("rank") <= 5).alias("in_beam"))


@query("k12_priority_order", f"{E0}, q AS (SELECT candidate_id, CASE WHEN candidate_id IN (3, 5) THEN 1000 ELSE 0 END + CASE WHEN cached THEN 100 ELSE 0 END + CASE WHEN candidate_id // 2 IN (10, 20, 30) THEN 10 ELSE 0 END + greatest(0, 5 - generation) - candidate_id * 0.001::DOUBLE AS p FROM ev WHERE candidate_id NOT IN (4)) SELECT candidate_id, round(p, 6) AS priority, row_number() OVER (ORDER BY p DESC, candidate_id) AS position FROM q")
def k12(spark, d):
    ev = evaluations(spark, d).withColumn("fp", F.col("candidate_id")).withColumn("parents", F.array(F.floor(F.col("candidate_id") / 2))).withColumn("proposal_index", F.col("candidate_id"))
    out = K.priority_order(ev.drop("cached"), [3, 5], [4], ev.where("cached"), [10, 20, 30]).withColumn("_k", F.lit(0))
    return ranked(out, ["_k"], [F.col("priority").desc(), F.col("candidate_id").asc()], "position").select("candidate_id", r("priority").alias("priority"), "position")


@query("k11_novelty_selection")
def k11(spark, d):
    """Fitness mixed with distance to the chosen, over the whole eligible pool each round."""
    ev = evaluations(spark, d).where("eligible")
    picked = K.greedy_batch(ev, "candidate_id", SPACE, F.col("fitness"), 6, novelty_weight=0.5)
    ids = [int(c["_id"]) for c in picked]
    position = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("candidate_id").cast("int"))
    return ev.where(F.col("candidate_id").isin(ids)).select("candidate_id", r("fitness").alias("fitness"), position.cast("int").alias("position"))


@query("a35_population_diversity", f"{E0}, q AS (SELECT * FROM ev WHERE generation < 100000) SELECT a.search_id, any_value(n) AS members, round(avg((abs(a.gain - b.gain) / 20 + abs(a.bright - b.bright) / 2 + abs(a.speed - b.speed) / 6 + CASE WHEN a.style = b.style THEN 0 ELSE 1 END + CASE WHEN a.flip = b.flip THEN 0 ELSE 1 END) / 5), 8) AS diversity FROM q a JOIN q b ON a.search_id = b.search_id AND a.candidate_id < b.candidate_id JOIN (SELECT search_id, count(*) AS n FROM q GROUP BY 1) c ON c.search_id = a.search_id GROUP BY 1")
def a35(spark, d):
    return K.pairwise_diversity(evaluations(spark, d), ["search_id"], SPACE).withColumn("diversity", r("diversity", 8))


TRAJ = """tr AS (SELECT *, max(CASE WHEN eligible THEN fitness END) OVER (PARTITION BY search_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ev)"""


@query("w21_best_so_far", f"{E0}, {TRAJ} SELECT candidate_id, search_id, eligible AND (prior IS NULL OR fitness > prior) AS is_new_best, round(greatest(CASE WHEN eligible THEN fitness END, prior), 6) + 0.0 AS best_fitness FROM tr")
def w21(spark, d):
    from tidemark.operators.sequence import chunk_width

    ev = evaluations(spark, d)
    out = K.trajectory(ev, ["search_id"], "sequence", chunk_width(ev, ["search_id"], "sequence"))
    return out.select("candidate_id", "search_id", "is_new_best", r("best_fitness").alias("best_fitness"))


GEN = "gn AS (SELECT search_id, generation, max(CASE WHEN eligible THEN fitness END) AS b FROM ev GROUP BY ALL), gb AS (SELECT search_id, generation, max(b) OVER (PARTITION BY search_id ORDER BY generation) AS best_fitness FROM gn), go AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY generation) AS k FROM gb), pf AS (SELECT search_id, k, best_fitness AS believed, CASE WHEN best_fitness IS NULL THEN 1 ELSE 0 END AS stale FROM go WHERE k = 1 UNION ALL SELECT go.search_id, go.k, CASE WHEN go.best_fitness IS NOT NULL AND (pf.believed IS NULL OR go.best_fitness - pf.believed > 0.2) THEN go.best_fitness ELSE pf.believed END, CASE WHEN go.best_fitness IS NOT NULL AND (pf.believed IS NULL OR go.best_fitness - pf.believed > 0.2) THEN 0 ELSE pf.stale + 1 END FROM pf JOIN go ON go.search_id = pf.search_id AND go.k = pf.k + 1), pz AS (SELECT search_id, arg_max(believed, k) AS believed_best, arg_max(stale, k) AS stale FROM pf GROUP BY 1)"


def _generations(ev):
    from tidemark.operators.sequence import running

    per = ev.groupBy("search_id", "generation").agg(F.max(F.when(F.col("eligible"), F.col("fitness"))).alias("b"))
    return running(per, ["search_id"], ["generation"], {"best_fitness": ("max", "b")})


@query("w22_patience", f"WITH RECURSIVE {EV}, {GEN} SELECT search_id, round(believed_best, 6) + 0.0 AS believed_best, stale AS generations_without_gain FROM pz")
def w22(spark, d):
    out = K.patience(_generations(evaluations(spark, d)), ["search_id"], 0.2)
    return out.select("search_id", r("believed_best").alias("believed_best"), "generations_without_gain")


@query("w23_low_acquisition_streak", f"{E0}, l AS (SELECT search_id, sequence, coalesce(fitness, -1000) < -20 AS low FROM ev), z AS (SELECT search_id, max(sequence) FILTER (NOT low) AS last_ok FROM l GROUP BY 1) SELECT l.search_id, count(*) FILTER (low AND sequence > coalesce(last_ok, -1)) AS streak FROM l JOIN z USING (search_id) GROUP BY 1")
def w23(spark, d):
    """Length of the run of low values at the end of each log: rows after the last good one."""
    ev = evaluations(spark, d).select("search_id", "sequence", (F.coalesce("fitness", F.lit(-1000.0)) < -20).alias("low"))
    last = ev.groupBy("search_id").agg(F.max(F.when(~F.col("low"), F.col("sequence"))).alias("last_ok"))
    after = F.col("low") & (F.col("sequence") > F.coalesce("last_ok", F.lit(-1)))
    return ev.join(last, "search_id").groupBy("search_id").agg(F.count(F.when(after, 1)).alias("streak"))


@query("a33_search_efficiency", f"""{E0}, {BEST}, fa AS (SELECT search_id, count(*) AS evaluations, avg(CASE WHEN usable THEN 0.0::DOUBLE ELSE 1 END) AS failure_rate, avg(CASE WHEN cached THEN 1.0::DOUBLE ELSE 0 END) AS cache_hit_rate, sum(wall_seconds) AS wall_seconds FROM ev GROUP BY 1),
 up AS (SELECT ev.search_id, count(*) AS evaluations_to_best, sum(wall_seconds) AS wall_seconds_to_best FROM ev JOIN be ON be.search_id = ev.search_id AND ev.sequence <= best_id GROUP BY 1), ti AS (SELECT search_id, count(*) AS tied FROM ev JOIN be USING (search_id) WHERE usable AND candidate_id <> best_id AND abs(best_fitness - fitness) <= 2 GROUP BY 1)
 SELECT search_id, evaluations, evaluations_to_best, round(failure_rate, 8) AS failure_rate, round(cache_hit_rate, 8) AS cache_hit_rate, round(wall_seconds, 3) AS wall_seconds, round(wall_seconds_to_best, 3) AS wall_seconds_to_best, round(best_fitness + 50, 6) AS improvement, best_fitness + 50 > 2 AS resolvable, coalesce(tied, 0) AS tied FROM fa JOIN be USING (search_id) JOIN up USING (search_id) LEFT JOIN ti USING (search_id)""")
def a33(spark, d):
    out = K.efficiency(evaluations(spark, d).withColumn("root", F.lit(-50.0)), ["search_id"], "sequence", "root", 2.0)
    return out.select("search_id", "evaluations", "evaluations_to_best", r("failure_rate", 8).alias("failure_rate"), r("cache_hit_rate", 8).alias("cache_hit_rate"),
                      r("wall_seconds", 3).alias("wall_seconds"), r("wall_seconds_to_best", 3).alias("wall_seconds_to_best"), r("improvement").alias("improvement"), "resolvable", "tied")


LED = """sp AS (SELECT search_id, count(*)::DOUBLE AS a, sum(CASE WHEN cached THEN 0.0::DOUBLE ELSE 1 END) AS b, sum(wall_seconds) AS c, sum(wall_seconds) / 3600 * 12 AS d, (max(generation) + 1)::DOUBLE AS e FROM ev GROUP BY 1),
 bk AS (SELECT search_id, unnest(['max_candidates', 'max_runs', 'max_wall_seconds', 'max_cost', 'max_generations']) AS "limit", unnest([a, b, c, d, e]) AS spent, unnest([400.0, 275.0, NULL, 60.0, 9.0])::DOUBLE AS ceiling FROM sp)"""
LIMITS = {"max_candidates": 400.0, "max_runs": 275.0, "max_cost": 60.0, "max_generations": 9.0}


@query("a34_budget_ledger", f"{E0}, {LED} SELECT search_id, \"limit\", round(spent, 6) AS spent, round(greatest(0, ceiling - spent), 6) + CASE WHEN ceiling IS NULL THEN NULL ELSE 0.0 END AS remaining, coalesce(ceiling IS NOT NULL AND greatest(0, ceiling - spent) <= 0, false) AS exhausted, coalesce(ceiling - spent > 0 AND (ceiling - spent) / ceiling <= 0.2, false) AS low FROM bk")
def a34(spark, d):
    out = K.ledger(evaluations(spark, d), ["search_id"], LIMITS, 12.0)
    return out.select("search_id", "limit", r("spent").alias("spent"), r("remaining").alias("remaining"), "exhausted", "low")


@query("e45_stop_verdict", f"WITH RECURSIVE {EV}, {GEN}, {BEST}, {LED}, x AS (SELECT search_id, min(CASE \"limit\" WHEN 'max_candidates' THEN 1 WHEN 'max_runs' THEN 2 WHEN 'max_wall_seconds' THEN 3 WHEN 'max_cost' THEN 4 ELSE 5 END) FILTER (ceiling IS NOT NULL AND ceiling - spent <= 0) AS o FROM bk GROUP BY 1) SELECT search_id, CASE WHEN o IS NOT NULL THEN ['max_candidates', 'max_runs', 'max_wall_seconds', 'max_cost', 'max_generations'][o] WHEN best_fitness >= 5 THEN 'target_reached' WHEN stale >= 3 THEN 'no_improvement' END AS stop_reason FROM x LEFT JOIN be USING (search_id) LEFT JOIN pz USING (search_id)")
def e45(spark, d):
    ev = evaluations(spark, d)
    books = K.ledger(ev, ["search_id"], LIMITS, 12.0)
    stale = K.patience(_generations(ev), ["search_id"], 0.2)
    return K.stop_verdict(books, K.best_of(ev, ["search_id"]), stale, ["search_id"], 5.0, 3)


COARSE = (Parameter("speed", "integer", 0, 6, modality="pace"), Parameter("style", "categorical", choices=(0.0, 1.0, 2.0)), Parameter("flip", "boolean", choices=(0.0, 1.0)))


@query("e45_space_exhausted", f"""{E0}, se AS (SELECT search_id, count(*) AS seen FROM (SELECT DISTINCT search_id, speed, style, flip FROM ev WHERE candidate_id % 2 = 0 OR search_id < 'M') GROUP BY 1)
 SELECT search_id, seen, 42.0::DOUBLE AS size, greatest(0, 42.0 - seen)::DOUBLE AS "left", CASE WHEN seen >= 42 THEN 'space_exhausted' END AS stop_reason FROM se""")
def e45_space(spark, d):
    """Searches over 7 x 3 x 2 points: done when every point was seen, whatever the order and the repeats."""
    ev = evaluations(spark, d).where("candidate_id % 2 = 0 OR search_id < 'M'")
    left = K.space_left(ev.withColumn("fp", K.fingerprint(COARSE)), ["search_id"], COARSE)
    books = K.ledger(ev, ["search_id"], {"max_generations": 1e9}, 0.0)
    best = K.best_of(ev, ["search_id"])
    stale = ev.select("search_id").distinct().withColumn("generations_without_gain", F.lit(0))
    return left.join(K.stop_verdict(books, best, stale, ["search_id"], None, 10**9, left=left), "search_id")


@query("e45_partial_admission", f"{E0}, {LED} SELECT search_id, CAST(greatest(0, least(40, floor(greatest(0, max(ceiling - spent) FILTER (\"limit\" = 'max_candidates'))), floor(greatest(0, max(ceiling - spent) FILTER (\"limit\" = 'max_runs'))))) AS INTEGER) AS admitted FROM bk GROUP BY 1")
def e45a(spark, d):
    books = K.ledger(evaluations(spark, d), ["search_id"], LIMITS, 12.0)
    left = lambda n: F.max(F.when(F.col("limit") == n, F.col("remaining")))
    return books.groupBy("search_id").agg(K.admit(F.lit(40), left("max_candidates"), left("max_runs")).alias("admitted"))


@query("a43_generation_counts", f"{E0} SELECT search_id, generation, status, count(*) AS n FROM ev GROUP BY ALL")
def a43g(spark, d):
    return evaluations(spark, d).groupBy("search_id", "generation", "status").agg(F.count(F.lit(1)).alias("n"))


@query("a45_run_benchmark", "SELECT l_returnflag AS run_id, count(*) AS rows_read, round(sum(l_quantity) / 100, 4) AS stage_seconds, round(sum(l_extendedprice) / (sum(l_quantity) / 100), 4) AS realtime_factor FROM lineitem GROUP BY 1")
def a45(spark, d):
    q, p = F.sum("l_quantity") / 100, F.sum("l_extendedprice")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.count(F.lit(1)).alias("rows_read"), r(q, 4).alias("stage_seconds"), r(p / q, 4).alias("realtime_factor"))


NB = """nb AS (SELECT candidate_id AS parent_id, unnest(['gain','gain','bright','bright','speed','speed','style','style','flip','flip']) AS parameter, unnest([gain, gain, bright, bright, speed, speed, style, style, flip, flip]) AS old_value,
 unnest([round(round_even(greatest(-10, least(10, gain - 1)) / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 12), round(round_even(greatest(-10, least(10, gain + 1)) / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 12),
 round(round_even(greatest(-1, least(1, bright - 0.1::DOUBLE)) / 0.01::DOUBLE, 0) * 0.01::DOUBLE, 12), round(round_even(greatest(-1, least(1, bright + 0.1::DOUBLE)) / 0.01::DOUBLE, 0) * 0.01::DOUBLE, 12),
 round_even(greatest(0, least(6, speed - 0.3::DOUBLE)), 0), round_even(greatest(0, least(6, speed + 0.3::DOUBLE)), 0), (style + 2) % 3, (style + 1) % 3, (flip + 1) % 2, (flip + 1) % 2]) AS new_value FROM ev)"""


@query("e32_axis_neighbours", f"{E0}, {NB} SELECT DISTINCT parent_id, parameter, round(old_value, 6) + 0.0 AS old_value, round(new_value, 6) + 0.0 AS new_value FROM nb WHERE old_value <> new_value")
def e32(spark, d):
    out = K.neighbours_of(evaluations(spark, d), "candidate_id", SPACE)
    return out.select("parent_id", "parameter", r("old_value").alias("old_value"), r("new_value").alias("new_value"))


@query("e30_candidate_grid", f"""{E0}, c AS (SELECT gain, bright, count(*) AS n FROM (SELECT round(round_even((gain + 10) / 5, 0) * 5 - 10, 6) AS gain, round(round_even((bright + 1) / 0.5, 0) * 0.5::DOUBLE - 1, 6) AS bright FROM ev) GROUP BY ALL),
 g AS (SELECT -10 + 5.0::DOUBLE * (i // 5) AS gain, -1 + 0.5::DOUBLE * (i % 5) AS bright FROM range(25) t(i)) SELECT round(g.gain, 6) + 0.0 AS gain, round(g.bright, 6) + 0.0 AS bright, coalesce(n, 0) AS evaluated FROM g LEFT JOIN c ON c.gain = g.gain AND c.bright = g.bright""")
def e30(spark, d):
    """Grid points of two parameters with the evaluated candidates nearest to each."""
    points = K.grid(spark, SPACE[:2], 5, limit=1_000_000).select(*[r(K.get(p)).alias(p.name) for p in SPACE[:2]])
    ev = _flat(evaluations(spark, d))
    near = ev.select(r(F.rint((F.col("gain") + 10) / 5) * 5 - 10).alias("gain"), r(F.rint((F.col("bright") + 1) / 0.5) * 0.5 - 1).alias("bright"))
    counts = near.groupBy("gain", "bright").agg(F.count(F.lit(1)).alias("n"))
    return points.join(counts, ["gain", "bright"], "left").select("gain", "bright", F.coalesce("n", F.lit(0)).alias("evaluated"))


@query("e31_random_candidates")
def e31(spark, d):
    out = K.random_candidates(table(spark, d, "part").select("p_partkey"), "p_partkey", SPACE, 7)
    return out.select("p_partkey", *[K.get(p).alias(p.name) for p in SPACE])


@query("e33_mutation")
def e33(spark, d):
    out = K.mutate(evaluations(spark, d), "candidate_id", SPACE, 11, "medium", 0.5)
    return out.select("parent_id", *[K.get(p).alias(p.name) for p in SPACE])


@query("e34_crossover")
def e34(spark, d):
    ev = evaluations(spark, d).select(F.floor(F.col("candidate_id") / 2).alias("pair"), "candidate_id", "values")
    pairs = ev.groupBy("pair").agg(F.min("candidate_id").alias("left_id"), F.min_by("values", "candidate_id").alias("left_values"), F.max("candidate_id").alias("right_id"), F.max_by("values", "candidate_id").alias("right_values"))
    out = K.crossover(pairs.where("left_id < right_id"), SPACE, 13)
    return out.select(F.col("parents")[0].alias("left_id"), F.col("parents")[1].alias("right_id"), *[K.get(p).alias(p.name) for p in SPACE])


@query("e35_next_generation")
def e35(spark, d):
    out = K.next_generation(evaluations(spark, d), SPACE, 8, 17, K.explore_rate(0.5, 0.9, 0.1, 4))
    return out.select("search_id", "eid", "origin", "fp", *[K.get(p).alias(p.name) for p in SPACE])


@query("e36_candidate_pool")
def e36(spark, d):
    ev = evaluations(spark, d).withColumn("fp", K.fingerprint(SPACE))
    out = K.candidate_pool(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", SPACE, ev.where("eligible"), ev, 23, 0.3)
    return out.select("fp", "origin", *[K.get(p).alias(p.name) for p in SPACE])


FPS = "fq AS (SELECT *, printf('%.6f|%.6f|%.6f', gain + 0.0, speed, style) AS fp FROM ev)"


def _keyed(spark, d):
    text = F.concat_ws("|", *[F.format_string("%.6f", n) for n in ("gain", "speed", "style")])
    return _flat(evaluations(spark, d)).withColumn("fp", text)


@query("e47_evaluation_cache", f"{E0}, {FPS}, st AS (SELECT search_id, fp, arg_max(struct_pack(f := fitness, s := status), sequence) AS c FROM fq WHERE generation < 5 AND status <> 'evaluation_failed' GROUP BY ALL) SELECT candidate_id, c IS NOT NULL AS hit, round(c.f, 6) + 0.0 AS cached_fitness FROM fq LEFT JOIN st USING (search_id, fp) WHERE generation >= 5")
def e47(spark, d):
    ev = _keyed(spark, d)
    out = K.cache_lookup(ev.where("generation >= 5").select("candidate_id", "search_id", "fp"), ev.where("generation < 5"), ["search_id"])
    return out.select("candidate_id", "hit", r("cached_fitness").alias("cached_fitness"))


@query("u05_exclude_seen", f"{E0}, {FPS}, k AS (SELECT generation, printf('%s|%.6f', fp, bright + 0.0) AS fp FROM fq) SELECT DISTINCT fp FROM k WHERE generation >= 5 AND fp NOT IN (SELECT fp FROM k WHERE generation < 5)")
def u05(spark, d):
    ev = _keyed(spark, d)
    ev = ev.withColumn("fp", F.concat_ws("|", "fp", F.format_string("%.6f", F.col("bright") + 0.0)))
    return ev.where("generation >= 5").select("fp").distinct().join(ev.where("generation < 5").select("fp"), "fp", "left_anti")


@query("u06_upsert", f"{E0}, o AS (SELECT candidate_id, fitness FROM ev WHERE generation < 6), n AS (SELECT candidate_id, fitness + 1 AS fitness FROM ev WHERE generation >= 4) SELECT candidate_id, round(fitness, 6) + 0.0 AS fitness FROM n UNION ALL SELECT candidate_id, round(fitness, 6) + 0.0 FROM o WHERE candidate_id NOT IN (SELECT candidate_id FROM n)")
def u06(spark, d):
    ev = evaluations(spark, d)
    old = ev.where("generation < 6").select("candidate_id", "fitness")
    new = ev.where("generation >= 4").select("candidate_id", (F.col("fitness") + 1).alias("fitness"))
    return new.unionByName(old.join(new.select("candidate_id"), "candidate_id", "left_anti")).withColumn("fitness", r("fitness"))


@query("e48_identity_differences", "WITH i AS (SELECT p_type AS search_id, CAST(count(DISTINCT p_brand) AS VARCHAR) AS brands, CAST(min(p_size) AS VARCHAR) AS low, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1), u AS (SELECT b.search_id, unnest(['brands', 'low', 'n']) AS field, unnest([a.brands, a.low, a.n]) AS ref_value, unnest([b.brands, b.low, b.n]) AS cand_value FROM i a JOIN i b ON a.search_id = 'ECONOMY' AND b.search_id <> 'ECONOMY') SELECT * FROM u WHERE ref_value <> cand_value")
def e48(spark, d):
    from tidemark.operators.compare import comparability

    ident = table(spark, d, "part").groupBy(F.col("p_type").alias("run_id")).agg(F.countDistinct("p_brand").alias("brands"), F.min("p_size").alias("low"), F.count(F.lit(1)).alias("n"))
    pairs = ident.where("run_id <> 'ECONOMY'").select(F.lit("ECONOMY").alias("ref_run"), F.col("run_id").alias("cand_run"))
    return comparability(ident, pairs, ["brands", "low", "n"]).select(F.col("cand_run").alias("search_id"), "field", "ref_value", "cand_value")


@query("e49_changed_parameters", f"{E0}, l AS (SELECT candidate_id, unnest(['gain','bright','speed','style','flip']) AS parameter, unnest([gain, bright, speed, style, flip]) AS value, unnest(['audio','visual','pace','visual','visual']) AS modality FROM ev) SELECT candidate_id, parameter, round(value, 6) AS value, modality, candidate_id || '-' || parameter AS evidence_id FROM l WHERE value <> 0")
def e49(spark, d):
    out = K.changed_parameters(evaluations(spark, d), "candidate_id", SPACE)
    return out.select("candidate_id", "parameter", r("value").alias("value"), "modality", "evidence_id")


@query("x25_verdict_labels", f"{E0}, {BEST} SELECT candidate_id, CASE WHEN NOT usable THEN 'unmeasured' WHEN NOT feasible THEN 'disqualified' WHEN candidate_id = best_id THEN 'best' WHEN abs(best_fitness - fitness) <= 2 THEN 'tied' ELSE 'behind' END AS standing FROM ev LEFT JOIN be USING (search_id)")
def x25(spark, d):
    ev = evaluations(spark, d)
    j = ev.join(K.best_of(ev, ["search_id"]), "search_id", "left")
    label = (F.when(~F.col("usable"), "unmeasured").when(~F.col("feasible"), "disqualified").when(F.col("candidate_id") == F.col("best_id"), "best")
             .when(F.abs(F.col("best_fitness") - F.col("fitness")) <= 2, "tied").otherwise("behind"))
    return j.select("candidate_id", label.alias("standing"))


@query("x26_derived_labels", f"{E0}, {LED} SELECT search_id, \"limit\", round(spent / ceiling, 6) AS used_fraction, CASE WHEN ceiling IS NULL THEN 'unlimited' WHEN spent >= ceiling THEN 'exhausted' WHEN (ceiling - spent) / ceiling <= 0.2 THEN 'low' ELSE 'open' END AS label FROM bk")
def x26(spark, d):
    b = K.ledger(evaluations(spark, d), ["search_id"], LIMITS, 12.0)
    label = F.when(F.col("ceiling").isNull(), "unlimited").when(F.col("exhausted"), "exhausted").when(F.col("low"), "low").otherwise("open")
    return b.select("search_id", "limit", r(F.col("spent") / F.col("ceiling")).alias("used_fraction"), label.alias("label"))


@query("f02_mutation_registry", "SELECT 'boolean' AS kind, p_partkey, ((p_size % 2) + 1) % 2 + 0.0::DOUBLE AS mutated FROM part")
def f02(spark, d):
    ev = evaluations(spark, d)
    flip = SPACE[4]
    new = K.MUTATIONS.get("boolean").build(flip, K.get(flip), 1, F.col("candidate_id"), 0.1)
    return ev.select(F.lit("boolean").alias("kind"), F.col("candidate_id").alias("p_partkey"), new.alias("mutated"))


