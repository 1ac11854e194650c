"""Optimisation report: user 0 against the users that score higher on the same objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import r
from tidemark.operators import improve as M
from tidemark.operators import pareto as PF
from tidemark.operators import scoring as S
from tidemark.operators.scoring import Objective
from tidemark.operators.timejoin import bucket_width
from tidemark.plans.content_queries import CV, IV, SH, _intervals
from tidemark.plans.registry import SP, UM, query
from tidemark.plans.scoring_queries import DOM, IDS, OBJECTIVES, RAW, SCORE, _scored, _series
from tidemark.session import durable
from tidemark.sources.tables import ship_panel, table, unit_map

SOURCE, REFERENCE, GAP = 0, 1, 8.0
KINDS = {"view": "motion", "click": "speech_present", "purchase": "cta_present", "signup": "text_present", "error": "audio_energy"}
REFS = "rf AS (SELECT run_id FROM tt WHERE total > (SELECT total FROM tt WHERE run_id = 0) AND run_id <> 0)"
PARTS = """co AS (SELECT cv.run_id, t, value / n AS c FROM cv JOIN (SELECT run_id, count(*) AS n FROM cv GROUP BY 1) USING (run_id)),
 sr AS (SELECT run_id, t, c, abs(c) / sum(abs(c)) OVER (PARTITION BY run_id) AS sh, 1.0::DOUBLE / count(*) OVER (PARTITION BY run_id) AS ev FROM co),
 pd AS (SELECT run_id, quantile_cont(g, 0.5) AS period FROM (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS g FROM co) WHERE g IS NOT NULL GROUP BY 1),
 mk AS (SELECT *, CASE WHEN sh < ev * 0.25 THEN 'weak' WHEN sh > ev * 2 THEN 'strong' END AS kind FROM sr),
 mg AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 8 THEN 0 ELSE 1 END AS nw FROM mk WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY run_id, kind ORDER BY t)),
 mi AS (SELECT *, sum(nw) OVER (PARTITION BY run_id, kind ORDER BY t) - 1 AS g FROM mg),
 il AS (SELECT run_id, kind, CAST(g AS BIGINT) AS interval_no, min(t) AS start_t, max(t) + any_value(coalesce(period, 1)) AS end_t, count(*) AS samples, sum(sh) AS share, sum(c) AS contribution FROM mi LEFT JOIN pd USING (run_id) GROUP BY run_id, kind, g),
 ix AS (SELECT il.*, q.reference_share FROM il LEFT JOIN (SELECT il.run_id, il.kind, il.interval_no, sum(sh) AS reference_share FROM il JOIN sr ON sr.run_id = 1 AND sr.t >= start_t AND sr.t < end_t GROUP BY ALL) q USING (run_id, kind, interval_no)),
 wk AS (SELECT 'weak-m-' || interval_no AS interval_id, * FROM ix WHERE run_id = 0 AND kind = 'weak')"""


def _parts(spark, d):
    objectives = (Objective("m", "MEAN_RESPONSE"),)
    ev, series, durations, width = _series(spark, d, objectives)
    return S.contributions(series, S.resolve_windows(ev, durations, objectives), objectives, width), width, ev


def _all_intervals(spark, d):
    parts, width, ev = _parts(spark, d)
    return M.detect_intervals(parts, REFERENCE, GAP, 24.0, width), ev


def _weak(spark, d):
    found, ev = _all_intervals(spark, d)
    mine = found.where((F.col("run_id") == SOURCE) & (F.col("kind") == "weak"))
    named = mine.withColumn("interval_id", F.concat(F.lit("weak-m-"), F.col("interval_no").cast("string")))
    return durable(named), ev


def _references(spark, d, scored=None):
    _, ranking = scored or _scored(spark, d)
    return durable(M.select_references(ranking, SOURCE))


def _features(ev):
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return ev.select("run_id", "t", F.element_at(names, F.col("unit_id")).alias("feature"), "value")


def _content_events(spark, d):
    from tidemark.plans.content_queries import _events

    kinds = F.create_map(*[F.lit(x) for x in ("speech", "speech_segment", "cta", "cta", "overlay", "text_overlay", "audio", "audio_segment", "shot", "shot")])
    return _intervals(_events(spark, d)).select("run_id", F.element_at(kinds, F.col("kind")).alias("event_type"), "start_t", "end_t")


EVT = "ek AS (SELECT run_id, CASE kind WHEN 'speech' THEN 'speech_segment' WHEN 'overlay' THEN 'text_overlay' WHEN 'audio' THEN 'audio_segment' ELSE kind END AS event_type, start_t, end_t FROM iv)"


@query("k14_reference_selection", f"{SCORE}, {REFS} SELECT run_id, round(total, 6) AS total_score FROM rf JOIN tt USING (run_id)")
def k14(spark, d):
    return _references(spark, d).withColumn("total_score", r("total_score"))


@query("k14_pareto_references", f"{SCORE}, {DOM} SELECT run_id FROM fr WHERE run_id <> 0")
def k14p(spark, d):
    scores, ranking = _scored(spark, d)
    front = PF.pareto_front(S.score_matrix(scores, IDS), "run_id", IDS)
    return M.select_references(ranking, SOURCE, "pareto_front", front=front).select("run_id")


SPEC = "sp0 AS (SELECT unnest(['m', 'p', 's']) AS objective_id, unnest(['maximize', 'minimize', 'target']) AS direction, unnest([NULL, NULL, 0.4])::DOUBLE AS tv)"
GAPS = f"""{SPEC}, gp AS (SELECT objective_id, direction, a.v AS source_value, CASE WHEN direction = 'target' THEN tv ELSE b.v END AS reference_value,
 CASE direction WHEN 'target' THEN abs(a.v - tv) WHEN 'maximize' THEN b.v - a.v ELSE a.v - b.v END AS gap FROM sp0 LEFT JOIN (SELECT * FROM rw WHERE run_id = 0) a ON a.o = objective_id LEFT JOIN (SELECT * FROM rw WHERE run_id = 1) b ON b.o = objective_id)"""


def _gaps(spark, d, scored=None):
    scores, _ = scored or _scored(spark, d)
    spec = S.objective_table(spark, OBJECTIVES)
    pick = lambda run: scores.where(F.col("run_id") == run).select("objective_id", "raw_value")
    return M.objective_gaps(pick(SOURCE), pick(REFERENCE), spec)


@query("e22_objective_gaps", f"""{SCORE}, {GAPS} SELECT objective_id, direction, round(source_value, 6) AS source_value, round(reference_value, 6) AS reference_value, round(gap, 6) + 0.0 AS gap,
 CASE WHEN abs(reference_value) > 1e-9 THEN round(gap / abs(reference_value), 6) + 0.0 END AS relative_gap, CASE direction WHEN 'target' THEN 'abs(source - target)' WHEN 'maximize' THEN 'reference - source' ELSE 'source - reference' END AS formula FROM gp""")
def e22(spark, d):
    out = _gaps(spark, d)
    return out.select("objective_id", "direction", *[r(c).alias(c) for c in ("source_value", "reference_value", "gap", "relative_gap")], "formula")


@query("w19_contribution_intervals", f"WITH {CV}, {PARTS} SELECT run_id, kind, interval_no, round(start_t, 5) AS start_t, round(end_t, 5) AS end_t, samples, round(share, 8) AS contribution_share, round(contribution, 8) AS contribution, round(reference_share, 8) AS reference_share FROM ix")
def w19(spark, d):
    out, _ = _all_intervals(spark, d)
    return out.select("run_id", "kind", "interval_no", r("start_t", 5).alias("start_t"), r("end_t", 5).alias("end_t"), "samples",
                      *[r(c, 8).alias(c) for c in ("contribution_share", "contribution", "reference_share")])


FM = f"""kf AS (SELECT run_id, t, CASE kind WHEN 'view' THEN 'motion' WHEN 'click' THEN 'speech_present' WHEN 'purchase' THEN 'cta_present' WHEN 'signup' THEN 'text_present' ELSE 'audio_energy' END AS feature, value FROM cv),
 fm AS (SELECT interval_id, kf.run_id, feature, avg(value) AS v FROM wk JOIN kf ON kf.t >= wk.start_t AND kf.t < wk.end_t GROUP BY ALL),
 fc AS (SELECT interval_id, kf.run_id, count(DISTINCT t) AS n FROM wk JOIN kf ON kf.t >= wk.start_t AND kf.t < wk.end_t GROUP BY ALL),
 fu2 AS (SELECT fm.*, n FROM fm JOIN fc USING (interval_id, run_id) WHERE n >= 2),
 fp AS (SELECT a.interval_id, a.feature, a.v AS sv, a.n AS sample_count, b.v - a.v AS d FROM fu2 a JOIN fu2 b ON a.run_id = 0 AND b.run_id IN (SELECT run_id FROM rf) AND a.interval_id = b.interval_id AND a.feature = b.feature),
 fe AS (SELECT interval_id, feature, sv AS source_value, sample_count, avg(d) AS delta, count(*) AS reference_count, max(abs(d)) AS big, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM fp GROUP BY ALL),
 fx AS (SELECT interval_id, feature, source_value, source_value + delta AS reference_value, delta, reference_count, CASE WHEN reference_count >= 2 THEN CASE WHEN delta > 0 THEN up WHEN delta < 0 THEN down ELSE reference_count - up - down END / reference_count END AS consistency, sample_count
  FROM fe WHERE abs(delta) / greatest(abs(source_value), big, 1e-9) >= 0.15)"""
PR = """hp AS (SELECT DISTINCT interval_id, ek.run_id, event_type FROM wk JOIN ek ON wk.samples >= 2 AND ek.start_t < wk.end_t AND ek.end_t > wk.start_t),
 pe AS (SELECT interval_id, event_type, count(*) AS reference_hits, (SELECT count(*) FROM rf) AS reference_count FROM hp WHERE run_id IN (SELECT run_id FROM rf) AND NOT EXISTS (SELECT 1 FROM hp o WHERE o.run_id = 0 AND o.interval_id = hp.interval_id AND o.event_type = hp.event_type) GROUP BY ALL)"""
CHAIN = f"WITH {CV}, {RAW}, {SH}, {IV}, {REFS}, {PARTS}, {EVT}"


def _evidence(spark, d, scored=None):
    weak, ev = _weak(spark, d)
    refs = _references(spark, d, scored)
    means, counts = M.interval_feature_means(weak, _features(ev), 24.0)
    return weak, refs, counts, M.feature_evidence(means, counts, SOURCE, refs)


@query("e23_feature_evidence", f"{CHAIN}, {FM} SELECT interval_id, feature, round(source_value, 6) AS source_value, round(reference_value, 6) AS reference_value, round(delta, 6) AS delta, reference_count, round(consistency, 6) AS consistency, sample_count FROM fx")
def e23(spark, d):
    out = _evidence(spark, d)[3]
    return out.select("interval_id", "feature", *[r(c).alias(c) for c in ("source_value", "reference_value", "delta", "consistency")], "reference_count", "sample_count")


@query("j13_missing_event_kinds", f"{CHAIN}, {PR} SELECT interval_id, event_type, reference_hits, reference_count, round(CASE WHEN reference_count >= 2 THEN reference_hits / reference_count END, 6) AS consistency FROM pe")
def j13(spark, d):
    weak, _ = _weak(spark, d)
    events = _content_events(spark, d)
    out = M.event_presence(weak, events, SOURCE, _references(spark, d), bucket_width(events, "start_t", "end_t"))
    return out.withColumn("consistency", r("consistency"))


@query("u02_kind_set_difference", f"WITH {CV} SELECT run_id, kind FROM cv WHERE t < 240 EXCEPT SELECT run_id, kind FROM cv WHERE t >= 480")
def u02(spark, d):
    """Kinds each run has in its first third and not in its last."""
    from tidemark.plans.content_queries import _events

    ev = _events(spark, d)
    early = ev.where(F.col("t") < 240.0).select("run_id", "kind").distinct()
    return early.join(ev.where(F.col("t") >= 480.0).select("run_id", "kind").distinct(), ["run_id", "kind"], "left_anti")


@query("j18_regional_evidence", f"""WITH {SP}, {UM}, m AS (SELECT run_id, region_id, avg(value) AS v FROM sp JOIN um USING (unit_id) WHERE region_id IS NOT NULL AND t >= 0 AND t < 1000 GROUP BY ALL), s AS (SELECT *, abs(v) / sum(abs(v)) OVER (PARTITION BY run_id) AS sh FROM m),
 b AS (SELECT y.run_id AS reference_run, region_id, x.v AS source_value, y.v AS reference_value, y.sh - x.sh AS share_delta FROM s x JOIN s y USING (region_id) WHERE x.run_id = 'A' AND y.run_id <> 'A'), k AS (SELECT *, row_number() OVER (PARTITION BY reference_run ORDER BY abs(share_delta) DESC, region_id) AS position FROM b)
 SELECT reference_run, region_id, round(source_value, 6) AS source_value, round(reference_value, 6) AS reference_value, round(share_delta, 8) AS share_delta, position FROM k WHERE position <= 3""")
def j18(spark, d):
    shares = durable(S.regional_contribution(ship_panel(spark, d), unit_map(spark, d), 0.0, 1000.0))
    refs = shares.where("run_id <> 'A'").select("run_id").distinct()
    out = M.regional_evidence(shares, "A", refs)
    return out.select("reference_run", "region_id", r("source_value").alias("source_value"), r("reference_value").alias("reference_value"), r("share_delta", 8).alias("share_delta"), "position")


@query("e24_evidence_rows", f"""WITH {CV}, {RAW}, {GAPS}, {PARTS} SELECT objective_id || '-GAP' AS evidence_id, 'objective_gap' AS kind, round(source_value, 6) AS source_value, round(reference_value, 6) AS reference_value, round(gap, 6) + 0.0 AS delta, NULL::BIGINT AS sample_count FROM gp WHERE gap IS NOT NULL
 UNION ALL SELECT interval_id || '-CONTRIB', 'contribution_share', round(share, 6), round(reference_share, 6), NULL, samples FROM wk""")
def e24(spark, d):
    weak, _ = _weak(spark, d)
    out = M.evidence_rows(_gaps(spark, d), weak)
    return out.select("evidence_id", "kind", *[r(c).alias(c) for c in ("source_value", "reference_value", "delta")], "sample_count")


STR = "least(1, abs({d}) / greatest(abs({a}), abs({b}), 1e-9))"
RUL = "ru AS (SELECT unnest([" + ", ".join(f"'{x[0]}'" for x in M.RULES) + "]) AS feature, unnest([" + ", ".join(f"'{x[1]}'" for x in M.RULES) + "]) AS intervention, unnest([" + ", ".join(f"'{x[2]}'" for x in M.RULES) + "]) AS template, unnest([" + ", ".join(f"'{x[3]}'" for x in M.RULES) + "]) AS cost, unnest([" + ", ".join(f"'{x[5]}'" for x in M.RULES) + "]) AS modality)"
REC = f"""gm AS (SELECT *, gap / abs(reference_value) AS rel FROM gp WHERE objective_id = 'm'),
 ga AS (SELECT CASE WHEN gap > 0 THEN CASE WHEN coalesce(rel, 0) <> 0 THEN least(1, abs(rel)) ELSE 0.5 END ELSE 0 END AS gpart, {STR.format(d='gap', a='source_value', b='reference_value')} AS gstr FROM gm),
 ra AS (SELECT fx.interval_id || '-' || feature AS recommendation_id, fx.interval_id, intervention, modality, cost, feature, replace(template, '{{interval}}', printf('%.2f-%.2fs', start_t, end_t)) AS title, start_t, end_t, samples,
  round(CASE WHEN samples < 2 THEN 0.5 ELSE 1 END * (0.4 * coalesce(consistency, 0) + 0.25 * ({STR.format(d='delta', a='source_value', b='reference_value')} + gstr) / 2 + 0.25 * gpart + 0.1 * 0.75), 4) AS confidence FROM fx JOIN ru USING (feature) JOIN wk USING (interval_id), ga WHERE delta > 0),
 re AS (SELECT pe.interval_id || '-event-' || event_type AS recommendation_id, pe.interval_id, CASE event_type WHEN 'cta' THEN 'cta_edit' WHEN 'speech_segment' THEN 'speech_edit' ELSE 'scene_structure_edit' END AS intervention,
  CASE event_type WHEN 'speech_segment' THEN 'speech' ELSE 'text' END AS modality, 'medium' AS cost, 'event:' || event_type AS feature, 'Introduce a ' || replace(event_type, '_', ' ') || ' into ' || printf('%.2f-%.2fs', start_t, end_t) AS title, start_t, end_t, samples,
  round(CASE WHEN samples < 2 THEN 0.5 ELSE 1 END * (0.4 * CASE WHEN reference_count >= 2 THEN reference_hits / reference_count ELSE 0 END + 0.25 * gstr + 0.25 * gpart + 0.1 * 0.75), 4) AS confidence FROM pe JOIN wk USING (interval_id), ga),
 rc AS (SELECT * FROM ra UNION ALL SELECT * FROM re)"""
RCH = f"{CHAIN}, {GAPS}, {FM}, {PR}, {RUL}, {REC}"


def _recommendations(spark, d):
    scored = _scored(spark, d)
    weak, refs, counts, found = _evidence(spark, d, scored)
    events = _content_events(spark, d)
    present = M.event_presence(weak, events, SOURCE, refs, bucket_width(events, "start_t", "end_t"))
    gaps = durable(_gaps(spark, d, scored))
    return M.recommend(found, present, weak, gaps), found, present, weak, gaps


@query("e25_rule_recommendations", f"{RCH} SELECT recommendation_id, intervention, modality, cost, title, round(confidence, 3) AS confidence FROM rc")
def e25(spark, d):
    out = _recommendations(spark, d)[0]
    return out.select("recommendation_id", "intervention", "modality", "cost", "title", r("confidence", 3).alias("confidence"))


@query("e26_evidence_confidence", f"{RCH} SELECT recommendation_id, round(confidence, 3) AS confidence FROM ra")
def e26(spark, d):
    out = _recommendations(spark, d)[0].where("feature NOT LIKE 'event:%'")
    return out.select("recommendation_id", r("confidence", 3).alias("confidence"))


VAL = """vr AS (SELECT rc.*, array_to_string(list_filter([CASE WHEN modality = 'audio' THEN 'frozen modality audio' END, CASE WHEN start_t < 300 AND end_t > 200 THEN 'overlaps a preserved interval' END,
 CASE WHEN intervention IN ('text_edit', 'cta_edit') THEN 'frozen event type' END, CASE WHEN end_t <= start_t THEN 'empty interval' END], lambda x: x IS NOT NULL), ';') AS reasons FROM rc)"""


def _checked(spark, d):
    made, found, present, weak, gaps = _recommendations(spark, d)
    ids = (found.select(F.concat_ws("-", "interval_id", "feature").alias("evidence_id"))
           .unionByName(present.select(F.concat_ws("-", "interval_id", F.lit("event"), "event_type").alias("evidence_id")))
           .unionByName(M.evidence_rows(gaps, weak).select("evidence_id")))
    return M.validation_reasons(made, ids, ("audio",), ((200.0, 300.0),), ("cta",)), ids, made


@query("p15_constraint_checks", f"{RCH}, {VAL} SELECT recommendation_id, reasons FROM vr")
def p15(spark, d):
    return _checked(spark, d)[0].select("recommendation_id", F.array_join("reasons", ";").alias("reasons"))


@query("j17_orphan_evidence", "SELECT l_orderkey, count(*) AS orphans FROM lineitem WHERE l_partkey * 10 + l_linenumber NOT IN (SELECT p_partkey * 10 + p_size FROM part) GROUP BY 1")
def j17(spark, d):
    cited = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("evidence_ids"))
    known = table(spark, d, "part").select((F.col("p_partkey") * 10 + F.col("p_size")).alias("evidence_id"))
    out = cited.select("l_orderkey", F.explode("evidence_ids").alias("evidence_id")).join(known, "evidence_id", "left_anti")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("orphans"))


DED = "dd AS (SELECT *, row_number() OVER w AS k, first_value(recommendation_id) OVER w AS best FROM vr WHERE reasons = '' WINDOW w AS (PARTITION BY intervention, round(start_t, 2), round(end_t, 2) ORDER BY confidence DESC, recommendation_id))"


@query("u07_deduplicate", f"{RCH}, {VAL}, {DED} SELECT recommendation_id, k = 1 AS kept, CASE WHEN k > 1 THEN best END AS duplicate_of FROM dd")
def u07(spark, d):
    checked, _, _ = _checked(spark, d)
    return M.deduplicate(checked.where(F.size("reasons") == 0)).select("recommendation_id", "kept", "duplicate_of")


RNK = """pr AS (SELECT *, round(confidence / CASE cost WHEN 'low' THEN 1.0 WHEN 'medium' THEN 1.6 ELSE 2.6 END, 6) AS priority FROM dd WHERE k = 1),
 pt AS (SELECT *, row_number() OVER (PARTITION BY intervention ORDER BY priority DESC, recommendation_id) AS tr FROM pr),
 pp AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN tr = 1 THEN 0 ELSE 1 END, priority DESC, recommendation_id) AS position FROM pt)"""


@query("k13_diverse_ranking", f"{RCH}, {VAL}, {DED}, {RNK} SELECT recommendation_id, intervention, round(priority, 3) AS priority, position FROM pp WHERE position <= 10")
def k13(spark, d):
    checked, _, _ = _checked(spark, d)
    kept = M.deduplicate(checked.where(F.size("reasons") == 0)).where("kept").drop("kept", "duplicate_of")
    return M.rank_recommendations(kept, 10).select("recommendation_id", "intervention", r("priority", 3).alias("priority"), "position")


@query("e27_optimisation_report", f"{RCH}, {VAL}, {DED}, {RNK} SELECT vr.recommendation_id, vr.title, CASE WHEN vr.reasons <> '' THEN 'rejected' WHEN dd.k > 1 THEN 'duplicate' ELSE 'kept' END AS verdict, vr.reasons, pp.position FROM vr LEFT JOIN dd USING (recommendation_id) LEFT JOIN (SELECT * FROM pp WHERE position <= 10) pp USING (recommendation_id)")
def e27(spark, d):
    """Gaps, weak intervals, evidence, rules, checks, dedupe and ranking in one report."""
    weak, ev = _weak(spark, d)
    scored = _scored(spark, d)
    events = _content_events(spark, d)
    verdicts, ranked = M.optimise(
        SOURCE, weak, durable(_gaps(spark, d, scored)), _features(ev), events, _references(spark, d, scored), 24.0, 10, bundles=False,
        frozen_modalities=("audio",), preserve=((200.0, 300.0),), frozen_events=("cta",))
    verdict = F.when(F.size("reasons") > 0, "rejected").when(~F.col("kept"), "duplicate").otherwise("kept")
    return durable(verdicts).select("recommendation_id", "title", verdict.alias("verdict"), F.array_join("reasons", ";").alias("reasons")).join(
        ranked.select("recommendation_id", "position"), "recommendation_id", "left")


@query("e25_bundles")
def e25b(spark, d):
    """Combined tests of up to three atomic recommendations per interval."""
    made = _recommendations(spark, d)[0]
    return M.bundle(made).select("recommendation_id", "intervention", "confidence", "title")


@query("e51_no_evidence_reason", f"""{CHAIN}, {FM}, cr AS (SELECT interval_id, count(*) AS c FROM fc WHERE n >= 2 AND run_id IN (SELECT run_id FROM rf) GROUP BY 1)
 SELECT interval_id, CASE WHEN samples < 2 THEN 'too few samples' WHEN coalesce(c, 0) = 0 THEN 'no reference covers it' WHEN c < (SELECT count(*) FROM rf) THEN 'some references do not cover it' ELSE 'no feature differed enough' END AS reason FROM wk LEFT JOIN cr USING (interval_id) WHERE interval_id NOT IN (SELECT interval_id FROM fx)""")
def e51(spark, d):
    weak, refs, counts, found = _evidence(spark, d)
    return M.no_evidence_reason(weak, counts, found, refs)


REVIEWS = "rv AS (SELECT 'R' || (o_custkey % 400) AS recommendation_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'modified' ELSE 'rejected' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS modified, o_orderkey AS seq FROM orders), rm AS (SELECT 'R' || p_partkey AS recommendation_id, p_type AS intervention FROM part), la AS (SELECT recommendation_id, arg_max(state, seq) AS state, max(seq) AS seq, max_by(struct_pack(m := modified), seq).m AS modified FROM rv GROUP BY 1)"


def _reviews(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "modified").otherwise("rejected")
    reviews = o.select(F.concat(F.lit("R"), (F.col("o_custkey") % 400).cast("string")).alias("recommendation_id"), state.alias("state"),
                       F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("modified"), F.col("o_orderkey").alias("seq"))
    recs = table(spark, d, "part").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("recommendation_id"), F.col("p_type").alias("intervention"))
    return recs, reviews


@query("e28_approved_spec", f"WITH {REVIEWS} SELECT recommendation_id, state, CASE WHEN state = 'modified' THEN coalesce(modified, intervention) ELSE intervention END AS intervention FROM rm JOIN la USING (recommendation_id) WHERE state IN ('approved', 'modified')")
def e28(spark, d):
    return M.approved_spec(*_reviews(spark, d)).select("recommendation_id", "state", "intervention")


@query("j23_latest_review_state", f"WITH {REVIEWS} SELECT recommendation_id, coalesce(state, 'pending') AS state FROM rm LEFT JOIN la USING (recommendation_id)")
def j23(spark, d):
    recs, reviews = _reviews(spark, d)
    return recs.join(M.latest_reviews(reviews), "recommendation_id", "left").select("recommendation_id", F.coalesce("state", F.lit("pending")).alias("state"))


@query("p29_approval_exists", f"WITH {REVIEWS} SELECT recommendation_id FROM rm WHERE recommendation_id IN (SELECT recommendation_id FROM la WHERE state = 'approved')")
def p29(spark, d):
    recs, reviews = _reviews(spark, d)
    return recs.join(M.latest_reviews(reviews).where("state = 'approved'"), "recommendation_id", "left_semi").select("recommendation_id")


OUT = """oc AS (SELECT a.run_id, a.o AS objective_id, p.v AS parent_value, a.v AS candidate_value, CASE a.o WHEN 'm' THEN a.v - p.v WHEN 'p' THEN p.v - a.v ELSE abs(p.v - 0.4) - abs(a.v - 0.4) END AS pref FROM rw a JOIN rw p ON p.run_id = 0 AND p.o = a.o AND a.run_id <> 0),
 ol AS (SELECT run_id, objective_id, candidate_value - parent_value AS raw_delta, CASE WHEN pref IS NULL THEN 'inconclusive' WHEN pref > 5 THEN 'improved' WHEN pref < -5 THEN 'worsened' ELSE 'unchanged' END AS outcome FROM oc)"""


def _outcomes(spark, d):
    scores, _ = _scored(spark, d)
    spec = S.objective_table(spark, OBJECTIVES).select("objective_id", "target_value")
    parent = scores.where(F.col("run_id") == SOURCE).select("objective_id", F.col("raw_value").alias("parent_value"))
    pairs = scores.where(F.col("run_id") != SOURCE).select("run_id", "objective_id", "direction", F.col("raw_value").alias("candidate_value"))
    return M.outcomes(pairs.join(parent, "objective_id").join(spec, "objective_id"), 5.0)


@query("e29_objective_outcomes", f"WITH {CV}, {RAW}, {OUT} SELECT run_id, objective_id, round(raw_delta, 6) + 0.0 AS raw_delta, outcome FROM ol")
def e29(spark, d):
    return _outcomes(spark, d).select("run_id", "objective_id", r("raw_delta").alias("raw_delta"), "outcome")


@query("a43_outcome_counts", f"WITH {CV}, {RAW}, {OUT} SELECT objective_id, outcome, count(*) AS n FROM ol GROUP BY ALL")
def a43o(spark, d):
    return _outcomes(spark, d).groupBy("objective_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("j19_hypothesis_outcome", f"WITH {CV}, {RAW}, {OUT}, hy AS (SELECT c_custkey AS hypothesis_id, c_custkey % 200 AS run_id, ['m', 'p', 'x'][c_custkey % 3 + 1] AS objective_id FROM customer) SELECT hypothesis_id, coalesce(outcome, 'inconclusive') AS outcome FROM hy LEFT JOIN ol USING (run_id, objective_id)")
def j19(spark, d):
    names = F.element_at(F.array(F.lit("m"), F.lit("p"), F.lit("x")), (F.col("c_custkey") % 3).cast("int") + 1)
    hyp = table(spark, d, "customer").select(F.col("c_custkey").alias("hypothesis_id"), (F.col("c_custkey") % 200).alias("run_id"), names.alias("objective_id"))
    out = hyp.join(_outcomes(spark, d), ["run_id", "objective_id"], "left")
    return out.select("hypothesis_id", F.coalesce("outcome", F.lit("inconclusive")).alias("outcome"))
