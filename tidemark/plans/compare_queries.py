"""Time joins and variant comparison over events and shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import r
from tidemark.functions.stats import pearson_p
from tidemark.operators import compare as C
from tidemark.operators import comparison as V
from tidemark.operators import panel as P
from tidemark.operators.sequence import chunk_width
from tidemark.operators.timejoin import covering, interpolate, nearest, tolerance_join
from tidemark.plans.registry import ES, RT, SP, UM, query
from tidemark.session import durable
from tidemark.sources.tables import event_series, ship_panel, table, unit_map

HOUR = 3600.0


def _kind(spark, d, kind, prefix):
    es = event_series(spark, d).where(F.col("kind") == kind)
    return es.select("run_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("row_key", "t", "value")])


def _width(spark, d):
    return chunk_width(event_series(spark, d), ["run_id"], "t")


SIDES = """p AS (SELECT run_id, row_key AS p_row_key, t AS p_t, value AS p_value FROM es WHERE kind = 'purchase'),
 v AS (SELECT run_id, row_key AS v_row_key, t AS v_t, value AS v_value FROM es WHERE kind = 'view'),
 lo AS (SELECT p.*, v.v_row_key AS lk, v.v_t AS lt, v.v_value AS lv FROM p ASOF LEFT JOIN v ON p.run_id = v.run_id AND p.p_t >= v.v_t),
 hi AS (SELECT p.p_row_key, v.v_row_key AS hk, v.v_t AS ht, v.v_value AS hv FROM p ASOF LEFT JOIN v ON p.run_id = v.run_id AND p.p_t <= v.v_t),
 lh AS (SELECT * FROM lo JOIN hi USING (p_row_key))"""


@query("j02_nearest_in_time", f"""WITH {ES}, {SIDES} SELECT run_id, p_row_key,
 CASE WHEN lt IS NOT NULL AND (ht IS NULL OR p_t - lt <= ht - p_t) THEN lk ELSE hk END AS v_row_key FROM lh""")
def j02(spark, d):
    p, v = _kind(spark, d, "purchase", "p"), _kind(spark, d, "view", "v")
    out = nearest(p, v, ["run_id"], "p_t", "v_t", ["v_row_key"], _width(spark, d))
    return out.select("run_id", "p_row_key", F.col("hit.v_row_key").alias("v_row_key"))


@query("j03_covering_row", f"""WITH {ES}, {SIDES} SELECT run_id, p_row_key,
 CASE WHEN p_t < lt + 3600 * lv THEN lk END AS v_row_key FROM lh""")
def j03(spark, d):
    p = _kind(spark, d, "purchase", "p")
    v = _kind(spark, d, "view", "v").withColumn("v_dur", F.col("v_value") * HOUR)
    out = covering(p, v, ["run_id"], "p_t", "v_t", "v_dur", ["v_row_key"], _width(spark, d))
    return out.select("run_id", "p_row_key", F.col("hit.v_row_key").alias("v_row_key"))


@query("j04_tolerance_join", f"""WITH {ES}, {SIDES}, m AS (SELECT p.run_id, p_row_key, v_row_key, (p_t + v_t) / 2 AS t,
 count(*) OVER (PARTITION BY p.run_id, p_row_key) AS ln, count(*) OVER (PARTITION BY p.run_id, v_row_key) AS rn
 FROM p JOIN v ON p.run_id = v.run_id AND abs(p_t - v_t) <= 7200)
 SELECT run_id, p_row_key, v_row_key, round(t, 3) AS t, ln > 1 OR rn > 1 AS ambiguous FROM m""")
def j04(spark, d):
    p, v = _kind(spark, d, "purchase", "p"), _kind(spark, d, "view", "v")
    out = tolerance_join(p, v, ["run_id"], "p_t", "v_t", 2 * HOUR)
    return out.select("run_id", "p_row_key", "v_row_key", r("t", 3).alias("t"), "ambiguous")


@query("j05_interpolation_join", f"""WITH {ES}, {SIDES} SELECT run_id, p_row_key,
 CASE WHEN ht = lt THEN round(lv, 6) WHEN ht - lt <= 864000 THEN round(lv * (1 - (p_t - lt) / (ht - lt)) + hv * ((p_t - lt) / (ht - lt)), 6) END AS value FROM lh""")
def j05(spark, d):
    p, v = _kind(spark, d, "purchase", "p"), _kind(spark, d, "view", "v")
    out = interpolate(p, v, ["run_id"], "p_t", "v_t", "v_value", 240 * HOUR, width=_width(spark, d))
    return out.select("run_id", "p_row_key", r("interpolated").alias("value"))


@query("x22_resample_hold_ends", f"""WITH {ES}, {SIDES} SELECT run_id, p_row_key, round(CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv
 WHEN ht = lt THEN lv ELSE lv * (1 - (p_t - lt) / (ht - lt)) + hv * ((p_t - lt) / (ht - lt)) END, 6) AS value FROM lh""")
def x22(spark, d):
    p, v = _kind(spark, d, "purchase", "p"), _kind(spark, d, "view", "v")
    out = interpolate(p, v, ["run_id"], "p_t", "v_t", "v_value", hold_ends=True, width=_width(spark, d))
    return out.select("run_id", "p_row_key", r("interpolated").alias("value"))


@query("x24_nearest_gap", f"""WITH {ES}, {SIDES} SELECT run_id, p_row_key, round(least(p_t - lt, ht - p_t), 3) AS gap,
 lt IS NOT NULL AND ht IS NOT NULL AS within_coverage FROM lh""")
def x24(spark, d):
    from tidemark.operators.timejoin import asof

    p, v = _kind(spark, d, "purchase", "p"), _kind(spark, d, "view", "v")
    out = asof(p, v, ["run_id"], "p_t", "v_t", ["v_t"], _width(spark, d))
    gap = F.least(F.col("p_t") - F.col("lo.v_t"), F.col("hi.v_t") - F.col("p_t"))
    return out.select("run_id", "p_row_key", r(gap, 3).alias("gap"),
                      (F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("within_coverage"))


# Run A is the reference; candidates keep their own, shifted time axis.
def _aligned(spark, d):
    shift = F.when(F.col("run_id") == "N", 0.25).when(F.col("run_id") == "R", 0.125).otherwise(0.0)
    panel = durable(ship_panel(spark, d).withColumn("t", F.col("t") + shift))  # read by both sides
    rows = panel.select("run_id", "row_idx", "t").distinct()
    pairs = (
        rows.select(F.col("run_id").alias("cand_run")).distinct().where("cand_run <> 'A'")
        .withColumn("ref_run", F.lit("A"))
    )
    return panel, rows, pairs, C.align_rows(rows, pairs, 0.3, 1.0)


AL = """rw AS (SELECT DISTINCT run_id, row_idx, t + CASE run_id WHEN 'N' THEN 0.25 WHEN 'R' THEN 0.125 ELSE 0 END AS t FROM sp),
 al AS (SELECT a.run_id AS ref_run, b.run_id AS cand_run, a.row_idx AS ref_row, b.row_idx AS cand_row, (a.t + b.t) / 2 AS t
  FROM rw a JOIN rw b ON a.run_id = 'A' AND b.run_id <> 'A' AND abs(a.t - b.t) <= 0.3)"""
DE = """de AS (SELECT ref_run, cand_run, ref_row, cand_row, al.t, a.unit_id, a.value AS rv, b.value AS cv, b.value - a.value AS d
  FROM al JOIN sp a ON a.run_id = ref_run AND a.row_idx = ref_row
  JOIN sp b ON b.run_id = cand_run AND b.row_idx = cand_row AND b.unit_id = a.unit_id
  JOIN um ON um.unit_id = a.unit_id WHERE NOT excluded)"""
RD = """rd AS (SELECT ref_run, cand_run, ref_row, cand_row, t, sqrt(sum(d * d)) AS l2, sqrt(avg(d * d)) AS rms, avg(d) AS mean_delta,
  avg(abs(d)) AS mean_abs_delta, sum(rv * cv) / (sqrt(sum(rv * rv)) * sqrt(sum(cv * cv))) AS cosine, count(*) AS finite_count FROM de GROUP BY ALL)"""
GD = """gd AS (SELECT ref_run, cand_run, ref_row, cand_row, al.t, a.region_id, b.value - a.value AS d
  FROM al JOIN rt a ON a.run_id = ref_run AND a.row_idx = ref_row
  JOIN rt b ON b.run_id = cand_run AND b.row_idx = cand_row AND b.region_id = a.region_id)"""


def _delta(spark, d):
    panel, rows, pairs, aligned = _aligned(spark, d)
    cells = panel.join(unit_map(spark, d).where("NOT excluded").select("unit_id"), "unit_id", "left_semi")
    return C.difference(aligned, cells), rows, aligned, panel


@query("j10_variant_difference", f"WITH {SP}, {UM}, {AL}, {DE} SELECT cand_run, ref_row, unit_id, round(d, 6) + 0.0 AS delta FROM de")
def j10(spark, d):
    return _delta(spark, d)[0].select("cand_run", "ref_row", "unit_id", r("delta").alias("delta"))


@query("a13_row_differences", f"""WITH {SP}, {UM}, {AL}, {DE}, {RD} SELECT cand_run, ref_row, cand_row, t, round(l2, 6) AS l2, round(rms, 6) AS rms,
 round(mean_delta, 6) + 0.0 AS mean_delta, round(mean_abs_delta, 6) AS mean_abs_delta, round(cosine, 8) AS cosine, finite_count FROM rd""")
def a13(spark, d):
    out = C.row_differences(_delta(spark, d)[0])
    cols = ("l2", "rms", "mean_delta", "mean_abs_delta")
    return out.select("cand_run", "ref_row", "cand_row", "t", *[r(c).alias(c) for c in cols], r("cosine", 8).alias("cosine"), "finite_count")


@query("a14_hemisphere_differences", f"""WITH {SP}, {UM}, {AL}, {DE} SELECT cand_run, t, round(avg(d) FILTER (hemisphere = 'left'), 6) + 0.0 AS left_delta,
 round(avg(d) FILTER (hemisphere = 'right'), 6) + 0.0 AS right_delta,
 round(avg(d) FILTER (hemisphere = 'left') - avg(d) FILTER (hemisphere = 'right'), 6) + 0.0 AS left_minus_right
 FROM de JOIN um USING (unit_id) GROUP BY ALL""")
def a14(spark, d):
    out = C.hemisphere_differences(_delta(spark, d)[0], unit_map(spark, d))
    return out.select("cand_run", "t", *[r(c).alias(c) for c in ("left_delta", "right_delta", "left_minus_right")])


SUMMARY = """SELECT cand_run, {key}, round(avg(d), 6) + 0.0 AS mean_signed_delta, round(avg(abs(d)), 6) AS mean_absolute_delta,
 round(sqrt(avg(d * d)), 6) AS rms_delta, round(max(abs(d)), 6) AS peak_absolute_delta,
 round(arg_max(d, struct_pack(a := abs(d), b := -t)), 6) AS peak_signed_delta, arg_max(t, struct_pack(a := abs(d), b := -t)) AS peak_time"""
SUMMARY_COLS = ("mean_signed_delta", "mean_absolute_delta", "rms_delta", "peak_absolute_delta", "peak_signed_delta")


def _region_delta(spark, d, level="region_id"):
    panel, rows, pairs, aligned = _aligned(spark, d)
    return C.difference(aligned, P.region_means(panel, unit_map(spark, d), level), level)


@query("a15_region_difference_summary", f"WITH {SP}, {UM}, {RT}, {AL}, {GD} {SUMMARY.format(key='region_id')} FROM gd GROUP BY ALL")
def a15(spark, d):
    out = C.difference_summary(_region_delta(spark, d), "region_id")
    return out.select("cand_run", "region_id", *[r(c).alias(c) for c in SUMMARY_COLS], "peak_time")


NT = """nt AS (SELECT run_id, row_idx, network_id, avg(value) AS value FROM sp JOIN um USING (unit_id) WHERE network_id IS NOT NULL GROUP BY ALL),
 nd AS (SELECT ref_run, cand_run, al.t, a.network_id, b.value - a.value AS d FROM al JOIN nt a ON a.run_id = ref_run AND a.row_idx = ref_row
  JOIN nt b ON b.run_id = cand_run AND b.row_idx = cand_row AND b.network_id = a.network_id)"""


@query("a15_network_difference_summary", f"WITH {SP}, {UM}, {AL}, {NT} {SUMMARY.format(key='network_id')} FROM nd GROUP BY ALL")
def a15n(spark, d):
    out = C.difference_summary(_region_delta(spark, d, "network_id"), "network_id")
    return out.select("cand_run", "network_id", *[r(c).alias(c) for c in SUMMARY_COLS], "peak_time")


@query("a16_alignment_coverage", f"""WITH {SP}, {AL}, n AS (SELECT run_id, count(*) AS n FROM rw GROUP BY 1)
 SELECT cand_run, count(*) AS aligned_samples, any_value(a.n) AS reference_samples, any_value(b.n) AS candidate_samples, min(t) AS first_time, max(t) AS last_time,
 round(count(*) / any_value(a.n), 8) AS reference_fraction, round(count(DISTINCT cand_row) / any_value(b.n), 8) AS candidate_fraction
 FROM al JOIN n a ON a.run_id = ref_run JOIN n b ON b.run_id = cand_run GROUP BY cand_run""")
def a16(spark, d):
    _, rows, _, aligned = _aligned(spark, d)
    out = C.alignment_coverage(aligned, rows)
    return out.select("cand_run", "aligned_samples", "reference_samples", "candidate_samples", "first_time", "last_time",
                      r("reference_fraction", 8).alias("reference_fraction"), r("candidate_fraction", 8).alias("candidate_fraction"))


EVT = """ai AS (SELECT *, row_number() OVER (PARTITION BY cand_run ORDER BY t) - 1 AS ix FROM rd),
 oo AS (SELECT *, row_number() OVER (PARTITION BY cand_run ORDER BY rms DESC, ix) AS k FROM ai WHERE rms > 0),
 ff AS (SELECT cand_run, 1 AS k, [ix] AS kept FROM oo WHERE k = 1 UNION ALL SELECT oo.cand_run, oo.k,
  CASE WHEN len(ff.kept) < 10 AND list_bool_and(list_transform(ff.kept, lambda x: abs(x - oo.ix) > 2)) THEN list_append(ff.kept, oo.ix) ELSE ff.kept END
  FROM ff JOIN oo ON oo.cand_run = ff.cand_run AND oo.k = ff.k + 1),
 zz AS (SELECT cand_run, arg_max(kept, k) AS kept FROM ff GROUP BY 1),
 ev AS (SELECT ai.*, list_position(kept, ix) AS event_rank FROM ai JOIN zz USING (cand_run) WHERE list_contains(kept, ix))"""


@query("w05_divergence_events", f"""WITH RECURSIVE {SP}, {UM}, {AL}, {DE}, {RD}, {EVT} SELECT cand_run, event_rank, ix AS aligned_index, t, round(rms, 6) AS score,
 round(l2, 6) AS l2, finite_count FROM ev""")
def w05(spark, d):
    out = C.rank_divergence(C.row_differences(_delta(spark, d)[0]), 1, 10)
    return out.select("cand_run", "event_rank", "aligned_index", "t", r("rms").alias("score"), r("l2").alias("l2"), "finite_count")


@query("w06_divergence_windows", f"""WITH RECURSIVE {SP}, {UM}, {AL}, {DE}, {RD}, {EVT},
 ws AS (SELECT e.cand_run, e.ix AS c, min(a.t) AS start_time, max(a.t) AS end_time, count(*) AS samples, avg(a.l2) AS mean_l2, avg(a.rms) AS mean_rms,
  max(a.rms) AS peak_rms, arg_max(a.t, a.rms) AS peak_time FROM ev e JOIN ai a ON a.cand_run = e.cand_run AND abs(a.ix - e.ix) <= 1 GROUP BY ALL)
 SELECT cand_run, start_time, end_time, samples, round(mean_l2, 6) AS mean_l2, round(mean_rms, 6) AS mean_rms, round(peak_rms, 6) AS peak_rms, peak_time,
 row_number() OVER (PARTITION BY cand_run ORDER BY mean_rms DESC, start_time) AS window_rank FROM ws""")
def w06(spark, d):
    rows = C.row_differences(_delta(spark, d)[0])
    out = C.rank_windows(C.rank_divergence(rows, 1, 10), rows, 1)
    return out.select("cand_run", "start_time", "end_time", "samples", *[r(c).alias(c) for c in ("mean_l2", "mean_rms", "peak_rms")],
                      "peak_time", "window_rank")


@query("k06_region_ranking", f"""WITH {SP}, {UM}, {RT}, {AL}, {GD}, s AS (SELECT cand_run, region_id, avg(abs(d)) AS m FROM gd GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY cand_run ORDER BY m DESC, region_id) AS position FROM s)
 SELECT cand_run, region_id, position, round(m, 6) AS mean_absolute_delta FROM k WHERE position <= 8""")
def k06(spark, d):
    out = C.region_ranking(C.difference_summary(_region_delta(spark, d), "region_id"), "region_id", 8)
    return out.select("cand_run", "region_id", "position", r("mean_absolute_delta").alias("mean_absolute_delta"))


@query("j15_comparability_gate", """WITH ma AS (SELECT p_brand AS run_id, CAST(count(DISTINCT p_type) AS VARCHAR) AS n_types,
 CAST(min(p_size) AS VARCHAR) AS min_size, CAST(max(p_size) AS VARCHAR) AS max_size, CASE WHEN max(p_partkey) % 3 > 0 THEN CAST(max(p_partkey) % 3 AS VARCHAR) END AS grade FROM part GROUP BY 1),
 u AS (SELECT b.run_id AS cand_run, unnest(['n_types','min_size','max_size','grade']) AS field,
  unnest([a.n_types, a.min_size, a.max_size, a.grade]) AS ref_value, unnest([b.n_types, b.min_size, b.max_size, b.grade]) AS cand_value
  FROM ma a JOIN ma b ON a.run_id = 'Brand#1' AND b.run_id <> 'Brand#1')
 SELECT * FROM u WHERE ref_value IS DISTINCT FROM cand_value""")
def j15(spark, d):
    grade = F.max("p_partkey") % 3
    man = table(spark, d, "part").groupBy(F.col("p_brand").alias("run_id")).agg(
        F.countDistinct("p_type").alias("n_types"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"),
        F.when(grade > 0, grade).alias("grade"),
    )
    pairs = man.where("run_id <> 'Brand#1'").select(F.lit("Brand#1").alias("ref_run"), F.col("run_id").alias("cand_run"))
    return C.comparability(man, pairs, ["n_types", "min_size", "max_size", "grade"]).drop("ref_run")


FEAT = """fr AS (SELECT l_returnflag AS run_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS row_idx,
 avg(l_quantity) AS quantity, avg(l_discount) AS discount, CASE WHEN count(*) % 2 = 0 THEN 1.0 ELSE 0.0 END AS mask FROM lineitem GROUP BY ALL),
 fd AS (SELECT ref_run, cand_run, al.t, b.quantity - a.quantity AS quantity, CASE WHEN a.mask > 0.5 AND b.mask > 0.5 THEN b.discount - a.discount END AS discount
  FROM al JOIN fr a ON a.run_id = ref_run AND a.row_idx = ref_row JOIN fr b ON b.run_id = cand_run AND b.row_idx = cand_row)"""


def _feature_delta(spark, d):
    from tidemark.functions.scalar import month_index

    _, _, _, aligned = _aligned(spark, d)
    li = table(spark, d, "lineitem")
    fr = li.groupBy(F.col("l_returnflag").alias("run_id"), month_index("l_shipdate", 1995).alias("row_idx")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.when(F.count(F.lit(1)) % 2 == 0, 1.0).otherwise(0.0).alias("mask"),
    )
    names = ("quantity", "discount", "mask")
    ref = fr.select(F.col("run_id").alias("ref_run"), F.col("row_idx").alias("ref_row"), *[F.col(n).alias(f"ref_{n}") for n in names])
    cand = fr.select(F.col("run_id").alias("cand_run"), F.col("row_idx").alias("cand_row"), *[F.col(n).alias(f"cand_{n}") for n in names])
    paired = aligned.join(ref, ["ref_run", "ref_row"]).join(cand, ["cand_run", "cand_row"])
    return C.feature_differences(paired, {"quantity": None, "discount": "mask"})


@query("p08_availability_gate", f"WITH {SP}, {AL}, {FEAT} SELECT cand_run, t, 'quantity' AS feature, round(quantity, 8) + 0.0 AS delta FROM fd UNION ALL SELECT cand_run, t, 'discount', round(discount, 8) + 0.0 FROM fd")
def p08(spark, d):
    return _feature_delta(spark, d).select("cand_run", "t", "feature", r("delta", 8).alias("delta"))


@query("e08_content_comparison", f"""WITH {SP}, {AL}, {FEAT}, l AS (SELECT cand_run, 'quantity' AS feature, quantity AS d FROM fd UNION ALL SELECT cand_run, 'discount', discount FROM fd)
 SELECT cand_run, feature, round(count(d) / count(*), 8) AS coverage_fraction, round(avg(d), 8) + 0.0 AS mean_signed_delta, round(avg(abs(d)), 8) AS mean_absolute_delta FROM l GROUP BY ALL""")
def e08(spark, d):
    out = C.feature_difference_summary(_feature_delta(spark, d))
    return out.select("cand_run", "feature", *[r(c, 8).alias(c) for c in ("coverage_fraction", "mean_signed_delta", "mean_absolute_delta")])


@query("e07_variant_comparison", f"""WITH RECURSIVE {SP}, {UM}, {RT}, {AL}, {DE}, {RD}, {GD}, {EVT},
 k AS (SELECT gd.cand_run, gd.ref_row, region_id, row_number() OVER (PARTITION BY gd.cand_run, gd.ref_row ORDER BY abs(d) DESC, region_id) AS k FROM gd),
 n AS (SELECT cand_run, ref_row, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY k) AS ids FROM k WHERE k <= 5 GROUP BY ALL)
 SELECT cand_run, event_rank, t, round(rms, 6) AS score, round(cosine, 8) AS cosine, finite_count, ids AS top_region_ids FROM ev JOIN n USING (cand_run, ref_row)""")
def e07(spark, d):
    """Gate, align, difference, summarise and rank in one plan for all candidates."""
    panel, rows, pairs, aligned = _aligned(spark, d)
    um = unit_map(spark, d)
    cells = panel.join(um.where("NOT excluded").select("unit_id"), "unit_id", "left_semi")
    events = C.rank_divergence(C.row_differences(C.difference(aligned, cells)), 1, 10)
    regions = C.difference(aligned, P.region_means(panel, um), "region_id")
    out = C.top_regions_of(events, regions, 5)
    return out.select("cand_run", "event_rank", "t", r("rms").alias("score"), r("cosine", 8).alias("cosine"), "finite_count",
                      F.array_join(F.col("top_region_ids").cast("array<string>"), ",").alias("top_region_ids"))


# Linear alignment: N runs a quarter of a month late and is interpolated, R an eighth and is taken as observed.
NEAR, GAP = 0.13, 1.5
LA = f"""rw AS (SELECT DISTINCT run_id, row_idx, t + CASE run_id WHEN 'N' THEN 0.25 WHEN 'R' THEN 0.125 ELSE 0 END AS t FROM sp),
 tg AS (SELECT a.run_id AS ref_run, c.cand_run, a.row_idx AS ref_row, a.t FROM rw a JOIN (SELECT DISTINCT run_id AS cand_run FROM rw WHERE run_id <> 'A') c ON a.run_id = 'A'),
 tl AS (SELECT tg.*, b.row_idx AS l_row, b.t AS l_t FROM tg ASOF LEFT JOIN rw b ON b.run_id = tg.cand_run AND tg.t >= b.t),
 th AS (SELECT tl.*, b.row_idx AS h_row, b.t AS h_t FROM tl ASOF LEFT JOIN rw b ON b.run_id = tl.cand_run AND tl.t <= b.t),
 tn AS (SELECT *, coalesce(t - l_t <= {NEAR}, false) AS nl, coalesce(h_t - t <= {NEAR}, false) AS nh FROM th),
 la AS (SELECT ref_run, cand_run, ref_row, t, CASE WHEN nl OR NOT nh THEN l_row ELSE h_row END AS left_row, CASE WHEN nl THEN l_row ELSE h_row END AS right_row,
  CASE WHEN nl OR nh THEN 0 ELSE (t - l_t) / (h_t - l_t) END AS weight, nl OR nh AS observed FROM tn
  WHERE NOT (nl AND nh AND l_row <> h_row) AND (nl OR nh OR h_t - l_t <= {GAP}))"""
LD = """ld AS (SELECT la.ref_run, la.cand_run, la.ref_row, la.t, a.unit_id, a.value AS rv, CASE WHEN observed THEN l.value ELSE l.value * (1 - weight) + h.value * weight END AS cv
  FROM la JOIN sp a ON a.run_id = la.ref_run AND a.row_idx = la.ref_row JOIN um ON um.unit_id = a.unit_id
  JOIN sp l ON l.run_id = la.cand_run AND l.row_idx = la.left_row AND l.unit_id = a.unit_id
  JOIN sp h ON h.run_id = la.cand_run AND h.row_idx = la.right_row AND h.unit_id = a.unit_id WHERE NOT excluded),
 rd AS (SELECT ref_run, cand_run, ref_row, t, sqrt(sum((cv - rv) * (cv - rv))) AS l2, sqrt(avg((cv - rv) * (cv - rv))) AS rms, count(*) AS finite_count FROM ld GROUP BY ALL)"""


def _shifted(spark, d):
    shift = F.when(F.col("run_id") == "N", 0.25).when(F.col("run_id") == "R", 0.125).otherwise(0.0)
    panel = durable(ship_panel(spark, d).withColumn("t", F.col("t") + shift))
    candidates = panel.select(F.col("run_id").alias("cand_run")).distinct().where("cand_run <> 'A'")
    return panel, candidates.withColumn("ref_run", F.lit("A")).select("ref_run", "cand_run")


def _linear(spark, d):
    panel, pairs = _shifted(spark, d)
    rows = panel.select("run_id", "row_idx", "t").distinct()
    return panel, rows, durable(V.align(rows, pairs, V.LINEAR, NEAR, GAP).where("problem IS NULL"))


@query("j05_linear_alignment", f"WITH {SP}, {LA} SELECT cand_run, ref_row, t, left_row, right_row, round(weight, 8) AS weight, observed FROM la")
def j05_linear(spark, d):
    return _linear(spark, d)[2].select("cand_run", "ref_row", "t", "left_row", "right_row", r("weight", 8).alias("weight"), "observed")


@query("a16_linear_coverage", f"""WITH {SP}, {LA}, n AS (SELECT run_id, count(*) AS n FROM rw GROUP BY 1),
 us AS (SELECT cand_run, count(DISTINCT x) AS used FROM (SELECT cand_run, unnest([left_row, right_row]) AS x FROM la) GROUP BY 1)
 SELECT la.cand_run, count(*) AS aligned_samples, count(*) FILTER (NOT observed) AS interpolated_samples, any_value(a.n) AS reference_samples, any_value(b.n) AS candidate_samples,
 min(t) AS first_time, max(t) AS last_time, round(count(*) / any_value(a.n), 8) AS reference_fraction, round(any_value(used) / any_value(b.n), 8) AS candidate_fraction
 FROM la JOIN us USING (cand_run) JOIN n a ON a.run_id = ref_run JOIN n b ON b.run_id = la.cand_run GROUP BY la.cand_run""")
def a16_linear(spark, d):
    _, rows, aligned = _linear(spark, d)
    fractions = [r(c, 8).alias(c) for c in ("reference_fraction", "candidate_fraction")]
    return V.coverage(aligned, rows).drop("ref_run", "reference_fraction", "candidate_fraction").join(
        V.coverage(aligned, rows).select("cand_run", *fractions), "cand_run")


@query("a13_linear_row_differences", f"""WITH {SP}, {UM}, {LA}, {LD}
 SELECT cand_run, ref_row, t, round(l2, 6) AS l2, round(rms, 6) AS rms, finite_count FROM rd""")
def a13_linear(spark, d):
    panel, _, aligned = _linear(spark, d)
    cells = panel.join(unit_map(spark, d).where("NOT excluded").select("unit_id"), "unit_id", "left_semi")
    out = C.row_differences(V.difference(aligned, cells))
    return out.select("cand_run", "ref_row", "t", r("l2").alias("l2"), r("rms").alias("rms"), "finite_count")


# A manifest for each brand: every field of the gate from counts of its parts, nulls included.
MANIFEST = {
    "synthetic_status": "k % 11 = 0", "model_fingerprint": "concat('m', CAST(c % 2 AS STRING))", "preprocessing_config": "CASE WHEN k % 4 > 0 THEN CAST(k % 4 AS STRING) END",
    "compatibility_patches": "CASE WHEN s > 49 THEN 'p' END", "surface_space": "'fs5'", "vertex_count": "CAST(s AS BIGINT)", "hemisphere_order": "'left,right'",
    "hemisphere_ranges": "concat('0,', CAST(s AS STRING))", "prediction_semantics": "'response'", "prediction_units": "CASE WHEN k % 3 = 0 THEN 'z' END",
    "prediction_normalization": "CASE WHEN c % 3 = 0 THEN 'unit' ELSE 'none' END", "includes_subcortex": "k % 2 = 0", "medial_wall_handling": "'kept'",
    "tr_seconds": "1.0 + (k % 2) / 2.0", "output_is_stimulus_aligned": "c % 2 = 0", "hemodynamic_offset_seconds": "5.0", "hemodynamic_offset_applied_to_raw": "false",
    "analytics_schema": "1", "analytics_version": "CAST(c % 4 AS STRING)", "analytics_aggregation": "'mean'", "atlas_name": "'a'", "atlas_version": "'1'",
    "atlas_surface": "'fs5'", "ordered_regions": "CAST(k % 2 AS STRING)", "stimulus_sha256": "sha2_of_size",
}
LISTED = ("run_id", "stimulus_sha256", *(f for f in V.SAME if f in MANIFEST))
_SQL_MANIFEST = ", ".join(f"{e.replace('sha2_of_size', 'sha256(CAST(s AS STRING))')} AS {f}" for f, e in MANIFEST.items())
_SQL_FAILED = ", ".join(
    f"CASE WHEN {'a.' + f + ' IS NOT DISTINCT FROM b.' + f if f in V.OTHER else 'a.' + f + ' IS DISTINCT FROM b.' + f} THEN '{f}' END" for f in LISTED)


def _manifests(spark, d):
    facts = table(spark, d, "part").groupBy(F.col("p_brand").alias("run_id")).agg(
        F.min("p_partkey").alias("k"), F.countDistinct("p_type").alias("c"), F.max("p_size").alias("s"))
    return facts.select("run_id", *[F.expr(e.replace("sha2_of_size", "sha2(CAST(s AS STRING), 256)")).alias(f) for f, e in MANIFEST.items()])


@query("j15_gate_report", f"""WITH g AS (SELECT p_brand AS run_id, min(p_partkey) AS k, count(DISTINCT p_type) AS c, max(p_size) AS s FROM part GROUP BY 1),
 ma AS (SELECT run_id, {_SQL_MANIFEST} FROM g), rp AS (SELECT b.run_id AS cand_run, concat_ws(',', {_SQL_FAILED}) AS fields FROM ma a JOIN ma b ON a.run_id = 'Brand#1')
 SELECT cand_run, fields = '' AS comparable, fields, {len(LISTED)} AS checks FROM rp""")
def j15_gate(spark, d):
    """Every brand against the first, itself included: that pair fails both must-differ rules."""
    manifests = durable(_manifests(spark, d))
    pairs = manifests.select(F.lit("Brand#1").alias("ref_run"), F.col("run_id").alias("cand_run"))
    out = V.comparability_report(manifests, pairs)
    fields = F.array_join(F.transform("issues", lambda x: x["field"]), ",")
    return out.select("cand_run", "comparable", fields.alias("fields"), F.size("checks").alias("checks"))


RUNS = """mf AS (SELECT l_returnflag AS run_id, sha256(CAST(sum(l_orderkey) AS STRING)) AS stimulus_sha256, CASE WHEN l_returnflag = 'R' AND count(*) > 0 THEN 'other' ELSE 'same' END AS model_fingerprint FROM lineitem GROUP BY 1)"""


def _comparison(spark, d, method, refuse=False, gate=True):
    panel, pairs = _shifted(spark, d)
    facts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(F.sum("l_orderkey").alias("k"))
    fingerprint = F.when((F.col("run_id") == "R") & F.lit(gate), "other").otherwise("same")
    manifests = facts.select("run_id", F.sha2(F.col("k").cast("string"), 256).alias("stimulus_sha256"), fingerprint.alias("model_fingerprint"))
    near = NEAR if method == V.LINEAR else 0.3
    return V.compare_variants(panel, unit_map(spark, d), pairs, manifests, method, near, GAP, max_events=10, refuse=refuse)


SUM = """SELECT p.cand_run, p.cand_run <> 'R' AS comparable, CASE WHEN p.cand_run = 'R' THEN 'model_fingerprint' ELSE '' END AS refused_fields, aligned_samples, interpolated_samples, events, peak_rms, peak_time, windows, window_rms
 FROM (SELECT DISTINCT run_id AS cand_run FROM sp WHERE run_id <> 'A') p LEFT JOIN
 (SELECT cand_run, count(*) AS aligned_samples, count(*) FILTER (NOT observed) AS interpolated_samples FROM {al} WHERE cand_run <> 'R' GROUP BY 1) USING (cand_run) LEFT JOIN
 (SELECT cand_run, count(*) AS events, round(max(rms), 6) AS peak_rms, arg_min(t, event_rank) AS peak_time FROM ev WHERE cand_run <> 'R' GROUP BY 1) USING (cand_run) LEFT JOIN
 (SELECT cand_run, count(*) AS windows, round(max(m), 6) AS window_rms FROM (SELECT DISTINCT e.cand_run, min(a.t) AS st, max(a.t) AS en, avg(a.rms) AS m
   FROM ev e JOIN ai a ON a.cand_run = e.cand_run AND abs(a.ix - e.ix) <= 1 WHERE e.cand_run <> 'R' GROUP BY e.cand_run, e.ix) GROUP BY 1) USING (cand_run)"""
SUM_COLS = ("cand_run", "comparable", "refused_fields", "aligned_samples", "interpolated_samples", "events", "peak_time", "windows")


def _summary(found):
    return V.summary(found).select(*SUM_COLS, r("peak_rms").alias("peak_rms"), r("window_rms").alias("window_rms"))


@query("e07_gated_comparison", f"""WITH RECURSIVE {SP}, {UM}, {AL}, {DE}, {RD}, {EVT}, ax AS (SELECT *, true AS observed FROM al) {SUM.format(al='ax')}""")
def e07_gated(spark, d):
    """Both candidates at once; R has another model, is refused before the panel is read and keeps its row."""
    return _summary(_comparison(spark, d, V.EXACT))


@query("e07_linear_comparison", f"""WITH RECURSIVE {SP}, {UM}, {LA}, {LD}, {EVT} {SUM.format(al='la')}""")
def e07_linear(spark, d):
    return _summary(_comparison(spark, d, V.LINEAR))


@query("e07_linear_events", f"""WITH RECURSIVE {SP}, {UM}, {LA}, {LD}, {EVT}
 SELECT cand_run, event_rank, ix AS aligned_index, t, round(rms, 6) AS score, round(l2, 6) AS l2, finite_count FROM ev""")
def e07_events(spark, d):
    events = _comparison(spark, d, V.LINEAR, gate=False).events
    return events.select("cand_run", "event_rank", "aligned_index", "t", r("rms").alias("score"), r("l2").alias("l2"), "finite_count")


COR = """fe AS (SELECT l_returnflag AS run_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS DOUBLE) AS t,
  avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY ALL),
 me AS (SELECT run_id, t, avg(value) AS mean_value, sqrt(sum(value * value)) AS magnitude FROM sp GROUP BY ALL),
 ta AS (SELECT run_id, t - lag AS tt, lag, mean_value, magnitude FROM me, (SELECT unnest([-2.0, -0.5, 0.0, 0.5, 2.0])::DOUBLE AS lag)),
 lo AS (SELECT ta.*, fe.t AS lt, fe.quantity AS lq, fe.discount AS ld FROM ta ASOF JOIN fe ON ta.run_id = fe.run_id AND ta.tt >= fe.t),
 ii AS (SELECT lo.*, fe.t AS ht, fe.quantity AS hq, fe.discount AS hd FROM lo ASOF JOIN fe ON lo.run_id = fe.run_id AND lo.tt <= fe.t),
 wx AS (SELECT *, CASE WHEN ht > lt THEN (tt - lt) / (ht - lt) ELSE 0 END AS w FROM ii),
 xy AS (SELECT run_id, lag, unnest(['quantity','quantity','discount','discount']) AS feature, unnest(['mean_value','magnitude','mean_value','magnitude']) AS metric,
  unnest([lq + (hq - lq) * w, lq + (hq - lq) * w, ld + (hd - ld) * w, ld + (hd - ld) * w]) AS x, unnest([mean_value, magnitude, mean_value, magnitude]) AS y FROM wx),
 ts AS (SELECT run_id, feature, metric, lag, count(*) AS n, corr(x, y) AS c FROM xy GROUP BY ALL HAVING count(*) >= 8)"""


def _tests(spark, d):
    from tidemark.functions.scalar import month_index

    feats = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run_id"), month_index("l_shipdate", 1995).cast("double").alias("t")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    v = F.col("value")
    metrics = ship_panel(spark, d).groupBy("run_id", "t").agg(F.avg(v).alias("mean_value"), F.sqrt(F.sum(v * v)).alias("magnitude"))
    return C.lagged_correlations(feats, ["quantity", "discount"], metrics, ["mean_value", "magnitude"], [-2.0, -0.5, 0.0, 0.5, 2.0])


@query("e06_lagged_correlations", f"WITH {SP}, {COR} SELECT run_id, feature, metric, lag, n, round(c, 6) + 0.0 AS correlation FROM ts")
def e06(spark, d):
    return _tests(spark, d).withColumn("correlation", r("correlation"))


@query("e06_best_lag", f"""WITH {SP}, {COR} SELECT run_id, feature, metric, count(*) AS lags_tested, arg_max(lag, struct_pack(a := abs(round(c, 4)), b := -lag)) AS lag,
 arg_max(n, struct_pack(a := abs(round(c, 4)), b := -lag)) AS n, round(arg_max(c, struct_pack(a := abs(round(c, 4)), b := -lag)), 6) + 0.0 AS correlation FROM ts GROUP BY ALL""")
def e06b(spark, d):
    return C.best_lag(_tests(spark, d)).withColumn("correlation", r("correlation"))


@query("e06_corrected_correlations")
def e06c(spark, d):
    """Adds p, Bonferroni and BH q over every test; the t distribution has no SQL form."""
    tests = _tests(spark, d).withColumn("p_value", F.round(pearson_p("correlation", "n"), 9))
    return C.multiplicity(tests, ["run_id"])


@query("e06_multiplicity", """WITH p AS (SELECT p_brand, p_partkey, (p_size * 37 + p_partkey * 11) % 997 / 997.0::DOUBLE * 0.2 AS p_value FROM part),
 k AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, rank() OVER (PARTITION BY p_brand ORDER BY p_value) + count(*) OVER (PARTITION BY p_brand, p_value) - 1 AS rk FROM p)
 SELECT p_brand, p_partkey, m AS comparisons, round(least(1, p_value * m), 8) AS p_bonferroni,
 round(least(1, min(p_value * m / rk) OVER (PARTITION BY p_brand ORDER BY p_value DESC, p_partkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q_value FROM k""".replace("ORDER BY p_value DESC, p_partkey RANGE", "ORDER BY p_value DESC RANGE"))
def e06m(spark, d):
    p = (F.col("p_size") * 37 + F.col("p_partkey") * 11) % 997 / F.lit(997.0) * F.lit(0.2)
    tests = table(spark, d, "part").select("p_brand", "p_partkey", p.alias("p_value"))
    out = C.multiplicity(tests, ["p_brand"])
    return out.select("p_brand", "p_partkey", "comparisons", r("p_bonferroni", 8).alias("p_bonferroni"), r("q_value", 8).alias("q_value"))
