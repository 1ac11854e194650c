"""Panel analytics over shipment and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import cosine, finite, r, safe_div
from tidemark.operators import panel as P
from tidemark.operators.ranks import exact_quantiles, top_k
from tidemark.operators.sequence import chunk_width, neighbours, ordinal
from tidemark.plans.registry import ES, RT, SP, UM, query
from tidemark.session import durable
from tidemark.sources.tables import event_series, ship_panel, table, unit_map


def _regions(spark, d, level="region_id"):
    return P.region_means(ship_panel(spark, d), unit_map(spark, d), level)


def _indexed_events(spark, d):
    es = event_series(spark, d)
    width = chunk_width(es, ["run_id"], "t")
    return ordinal(es, ["run_id"], ["t", "row_key"], "row_idx", width), width


ROWED = """ix AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, row_key) - 1 AS row_idx FROM es)"""


@query("j01_unit_region_lookup", f"WITH {UM} SELECT region_id, network_id, count(*) AS cells, round(sum(l_extendedprice),2) AS amount FROM lineitem JOIN um ON l_suppkey = unit_id WHERE region_id IS NOT NULL GROUP BY ALL")
def j01(spark, d):
    um = unit_map(spark, d).where("region_id IS NOT NULL").withColumnRenamed("unit_id", "l_suppkey")
    return (
        table(spark, d, "lineitem").join(um, "l_suppkey").groupBy("region_id", "network_id")
        .agg(F.count(F.lit(1)).alias("cells"), r(F.sum("l_extendedprice"), 2).alias("amount"))
    )


@query("a01_region_mean", f"WITH {SP}, {UM}, {RT} SELECT run_id, row_idx, t, region_id, round(value, 6) AS value FROM rt")
def a01(spark, d):
    return _regions(spark, d).withColumn("value", r("value"))


@query("a01_network_mean", f"WITH {SP}, {UM} SELECT run_id, row_idx, t, network_id, round(avg(value), 6) AS value FROM sp JOIN um USING (unit_id) WHERE network_id IS NOT NULL GROUP BY ALL")
def a01n(spark, d):
    return _regions(spark, d, "network_id").withColumn("value", r("value"))


@query("a02_hemisphere_mean", f"""WITH {SP}, {UM} SELECT run_id, row_idx, t,
 round(avg(value) FILTER (hemisphere = 'left'), 6) AS left_mean,
 round(avg(value) FILTER (hemisphere = 'right'), 6) AS right_mean,
 round(avg(value) FILTER (hemisphere = 'left') - avg(value) FILTER (hemisphere = 'right'), 6) + 0.0 AS left_minus_right
 FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY ALL""")
def a02(spark, d):
    out = P.hemisphere_means(ship_panel(spark, d), unit_map(spark, d))
    return out.select(*P.ROW, *[r(c).alias(c) for c in ("left_mean", "right_mean", "left_minus_right")])


@query("a03_global_metrics", f"""WITH {SP}, {UM} SELECT run_id, row_idx, t, round(avg(value), 6) AS mean,
 round(stddev_pop(value), 6) AS std, round(var_pop(value), 4) AS spatial_variance,
 round(sqrt(sum(value * value)), 6) AS l2_magnitude, round(sqrt(avg(value * value)), 6) AS rms_magnitude,
 round(quantile_cont(value, 0.5), 6) AS median FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY ALL""")
def a03(spark, d):
    out = P.global_metrics(durable(ship_panel(spark, d)), unit_map(spark, d))
    cols = ("mean", "std", "l2_magnitude", "rms_magnitude", "median")
    return out.select(*P.ROW, r("spatial_variance", 4).alias("spatial_variance"), *[r(c).alias(c) for c in cols])


CHANGE = """dl AS (SELECT run_id, unit_id, row_idx, t, value, lag(value) OVER w AS pv, lag(row_idx) OVER w AS pr
  FROM sp JOIN um USING (unit_id) WHERE NOT excluded WINDOW w AS (PARTITION BY run_id, unit_id ORDER BY t)),
 ch AS (SELECT run_id, row_idx, t, CASE WHEN row_idx = 0 THEN 0.0 ELSE
  sqrt(sum(CASE WHEN pr = row_idx - 1 THEN (value - pv) * (value - pv) END)) END AS change_magnitude FROM dl GROUP BY run_id, row_idx, t)"""


@query("a04_change_magnitude", f"WITH {SP}, {UM}, {CHANGE} SELECT run_id, row_idx, t, round(change_magnitude, 6) AS change_magnitude FROM ch")
def a04(spark, d):
    out = P.change_magnitude(ship_panel(spark, d), unit_map(spark, d))
    return out.withColumn("change_magnitude", r("change_magnitude"))


@query("a05_spatial_concentration", f"""WITH {SP}, {UM}, s AS (SELECT run_id, row_idx, t, sum(value * value) AS s2,
 sum(abs(value)) AS s1, count(*) AS n FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY ALL)
 SELECT run_id, row_idx, t, round(CASE WHEN n <= 1 OR s1 = 0 THEN 0.0
  ELSE (s2 / (s1 * s1) - 1.0::DOUBLE / n) / (1 - 1.0::DOUBLE / n) END, 8) AS concentration FROM s""")
def a05(spark, d):
    out = P.spatial_concentration(ship_panel(spark, d), unit_map(spark, d))
    return out.withColumn("concentration", r("concentration", 8))


@query("a06_region_summary", f"""WITH {SP}, {UM}, {RT}, pk AS (SELECT *, row_number() OVER (PARTITION BY run_id, region_id
 ORDER BY abs(value) DESC, row_idx) AS k FROM rt)
 SELECT run_id, region_id, round(avg(value), 6) AS mean_response, round(stddev_pop(value), 6) AS std_response,
 round(min(value), 6) AS min_response, round(max(value), 6) AS max_response,
 round(max(value) FILTER (k = 1), 6) AS peak_response, max(row_idx) FILTER (k = 1) AS peak_timestep,
 max(t) FILTER (k = 1) AS peak_time FROM pk GROUP BY ALL""")
def a06(spark, d):
    out = P.series_summary(_regions(spark, d), ["run_id", "region_id"])
    cols = ("mean_response", "std_response", "min_response", "max_response", "peak_response")
    return out.select("run_id", "region_id", *[r(c).alias(c) for c in cols], "peak_timestep", "peak_time")


@query("a07_region_correlation", f"""WITH {SP}, {UM}, {RT}, p AS (SELECT a.run_id, a.region_id AS region_id_a,
 b.region_id AS region_id_b, a.value AS x, b.value AS y FROM rt a JOIN rt b ON a.run_id = b.run_id
 AND a.row_idx = b.row_idx AND a.region_id <= b.region_id)
 SELECT run_id, region_id_a, region_id_b, count(*) AS n_pairs, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0
 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) + 0.0 END AS correlation FROM p GROUP BY ALL""")
def a07(spark, d):
    out = P.correlation_matrix(_regions(spark, d), "region_id")
    return out.withColumn("correlation", r("correlation"))


@query("a08_pattern_cosine_matrix", f"""WITH {SP}, {UM}, {RT} SELECT a.run_id, a.row_idx AS row_a, b.row_idx AS row_b,
 round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 6) AS cosine
 FROM rt a JOIN rt b ON a.run_id = b.run_id AND a.region_id = b.region_id AND a.row_idx <= b.row_idx GROUP BY ALL""")
def a08(spark, d):
    return P.temporal_similarity(_regions(spark, d), "region_id").withColumn("cosine", r("cosine"))


@query("a08_vector_to_centroid", """WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v
 FROM embeddings, range(1, 65) AS g(i)), c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY ALL)
 SELECT vec_id, label, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 6) + 0.0 AS cosine
 FROM x JOIN c USING (label, i) GROUP BY ALL""")
def a08v(spark, d):
    e = table(spark, d, "embeddings")
    mean = (
        e.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
        .groupBy("label").agg(P.ordered_list("i", "c").alias("centroid"))
    )
    return e.join(mean, "label").select(
        "vec_id", "label", r(cosine(F.col("embedding"), F.col("centroid"))).alias("cosine")
    )


@query("a09_window_summary", f"""WITH {SP}, {UM}, w AS (SELECT * FROM sp WHERE t BETWEEN 12 AND 35),
 l AS (SELECT run_id, row_idx, t, sqrt(sum(value * value)) AS l2, sum(value) AS s, count(*) AS n FROM w GROUP BY ALL),
 dl AS (SELECT run_id, row_idx, value - lag(value) OVER p AS d, lag(row_idx) OVER p AS pr FROM w
   WINDOW p AS (PARTITION BY run_id, unit_id ORDER BY t)),
 c AS (SELECT run_id, row_idx, sqrt(sum(CASE WHEN pr = row_idx - 1 THEN d * d END)) AS ch FROM dl GROUP BY ALL),
 f AS (SELECT run_id, min(t) AS start_time, max(t) AS end_time, sum(s) / sum(n) AS mean_response,
   avg(l2) AS mean_magnitude, arg_max(row_idx, l2) AS peak_timestep FROM l GROUP BY ALL),
 rm AS (SELECT run_id, row_idx, region_id, avg(value) AS v FROM w JOIN um USING (unit_id)
   WHERE region_id IS NOT NULL GROUP BY ALL),
 m AS (SELECT run_id, region_id, avg(v) AS m FROM rm GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(m) DESC, region_id) AS k FROM m)
 SELECT f.run_id, start_time, end_time, round(mean_response, 6) AS mean_response,
 round(mean_magnitude, 6) AS mean_magnitude, round(x.lc, 6) AS largest_change, peak_timestep, y.ids AS top_region_ids
 FROM f JOIN (SELECT run_id, max(ch) AS lc FROM c GROUP BY 1) x USING (run_id)
 JOIN (SELECT run_id, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY k) AS ids FROM k WHERE k <= 5 GROUP BY 1) y USING (run_id)""")
def a09(spark, d):
    out = P.window_summary(ship_panel(spark, d), unit_map(spark, d), 12, 35, 5)
    cols = ("mean_response", "mean_magnitude", "largest_change")
    return out.select(
        "run_id", "start_time", "end_time", *[r(c).alias(c) for c in cols], "peak_timestep",
        F.array_join(F.col("top_region_ids").cast("array<string>"), ",").alias("top_region_ids"),
    )


@query("a10_health_profile", f"""WITH {ES}, u AS (SELECT run_id, var_pop(value) AS v FROM es GROUP BY run_id, kind)
 SELECT run_id, count(*) AS cells, 0 AS nan_cells, 0 AS inf_cells, count(value) AS finite_cells,
 min(value) AS min_value, max(value) AS max_value, round(avg(value), 8) AS mean_value,
 round(stddev_pop(value), 6) AS std_value, any_value(cu) AS constant_units, any_value(mv) AS mean_unit_variance,
 round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50,
 round(quantile_cont(value, 0.99), 6) AS p99
 FROM es JOIN (SELECT run_id, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cu, round(avg(v), 4) AS mv FROM u GROUP BY 1) USING (run_id)
 GROUP BY run_id""")
def a10(spark, d):
    out = P.health_profile(event_series(spark, d).withColumnRenamed("kind", "unit_id"))
    return out.select(
        "run_id", "cells", "nan_cells", "inf_cells", "finite_cells", "min_value", "max_value",
        r("mean_value", 8).alias("mean_value"), r("std_value").alias("std_value"), "constant_units",
        r("mean_unit_variance", 4).alias("mean_unit_variance"),
        *[r(c).alias(c) for c in ("p01", "p50", "p99")],
    )


@query("a11_event_table_summary", f"""WITH {ES} SELECT kind, count(*) AS n_events, round(min(t), 6) AS first_start,
 round(max(t), 6) AS last_start, round(sum(value), 4) AS total_duration, round(avg(value), 8) AS mean_duration,
 count(DISTINCT run_id) AS n_runs FROM es GROUP BY kind""")
def a11(spark, d):
    return event_series(spark, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_events"), r(F.min("t")).alias("first_start"),
        r(F.max("t")).alias("last_start"), r(F.sum("value"), 4).alias("total_duration"),
        r(F.avg("value"), 8).alias("mean_duration"), F.countDistinct("run_id").alias("n_runs"),
    )


@query("a12_timeline_summary", f"""WITH {ES}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS gap FROM es)
 SELECT run_id, count(*) AS kept, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t,
 count(*) * 60.0::DOUBLE AS covered_seconds, round(max(gap), 3) AS largest_gap,
 coalesce(bool_and(abs(gap - 60) <= 1e-6), true) AS contiguous FROM g GROUP BY run_id""")
def a12(spark, d):
    es = event_series(spark, d)
    out = P.timeline_summary(es, 60.0, width=chunk_width(es, ["run_id"], "t"))
    return out.withColumn("first_t", r("first_t")).withColumn("last_t", r("last_t")).withColumn(
        "largest_gap", r("largest_gap", 3)
    )


@query("a41_sampling_period", f"""WITH {ES}, g AS (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS gap FROM es)
 SELECT run_id, round(quantile_cont(gap, 0.5), 3) AS period FROM g WHERE gap IS NOT NULL GROUP BY run_id""")
def a41(spark, d):
    es = event_series(spark, d)
    return P.sampling_period(es, chunk_width(es, ["run_id"], "t")).withColumn("period", r("period", 3))


@query("a12_timeline_coverage", f"""WITH {SP}, rw AS (SELECT DISTINCT run_id, row_idx FROM sp),
 sg AS (SELECT run_id, row_idx * 2.0::DOUBLE AS s, 2.0::DOUBLE AS l, part = 0 AS kept FROM rw, (VALUES (0), (1)) p(part) WHERE part = 0 OR row_idx % 3 = 0),
 kp AS (SELECT *, s - lag(s) OVER (PARTITION BY run_id ORDER BY s) AS gap FROM sg WHERE kept),
 ft AS (SELECT run_id, count(*) AS n_kept, min(s) AS first_start, max(s + l) AS last_end, sum(l) AS covered_seconds, coalesce(bool_and(abs(gap - 2) <= 1e-6), true) AS contiguous FROM kp GROUP BY 1),
 al AS (SELECT run_id, count(*) AS n_total FROM sg GROUP BY 1)
 SELECT *, concat_ws(',', CASE WHEN first_start - 5 < 0 THEN 'before_start' END, CASE WHEN n_total > n_kept AND contiguous AND abs(covered_seconds - (last_end - first_start)) <= 1e-6 THEN 'tiled' END) AS notes
 FROM al JOIN ft USING (run_id)""")
def a12c(spark, d):
    """Ship months as segments of two seconds; every third has a second, left-out segment."""
    rows = ship_panel(spark, d).select("run_id", "row_idx").distinct()
    parts = F.when(F.col("row_idx") % 3 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    segments = rows.select("run_id", (F.col("row_idx") * 2.0).alias("start_t"), F.lit(2.0).alias("duration"), F.explode(parts).alias("kept"))
    return P.timeline_coverage(segments, 2.0, offset=5.0)


@query("a38_frame_range", f"""WITH {SP} SELECT run_id, row_idx, round(coalesce(min(value), 0), 6) AS least, round(coalesce(max(value), 0), 6) AS greatest,
 round(coalesce(avg(value), 0), 6) AS mean, count(value) AS n_finite FROM sp GROUP BY ALL""")
def a38f(spark, d):
    out = P.frame_range(ship_panel(spark, d))
    return out.withColumns({c: r(c) for c in ("least", "greatest", "mean")})


@query("a38_display_scale", f"""WITH {ES} SELECT run_id, round(quantile_cont(value - 50, 0.01), 6) AS p01,
 round(quantile_cont(value - 50, 0.5), 6) AS p50, round(quantile_cont(value - 50, 0.99), 6) AS p99,
 round(avg(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END), 8) AS negative_fraction,
 round(greatest(abs(quantile_cont(value - 50, 0.01)), abs(quantile_cont(value - 50, 0.99))), 6) AS extent
 FROM es GROUP BY run_id""")
def a38(spark, d):
    shifted = event_series(spark, d).withColumn("value", F.col("value") - 50)
    out = P.display_scale(shifted)
    return out.select("run_id", *[r(c).alias(c) for c in ("p01", "p50", "p99", "extent")],
                      r("negative_fraction", 8).alias("negative_fraction"))


@query("a38_mean_over_time", f"WITH {SP} SELECT run_id, unit_id, round(avg(value), 6) AS mean_response FROM sp GROUP BY ALL")
def a38m(spark, d):
    return ship_panel(spark, d).groupBy("run_id", "unit_id").agg(r(F.avg("value")).alias("mean_response"))


@query("a37_region_contrast", f"""WITH {SP}, {UM}, m AS (SELECT run_id, unit_id, avg(value) AS v FROM sp GROUP BY ALL),
 dd AS (SELECT a.unit_id, a.v - b.v AS d FROM m a JOIN m b ON a.unit_id = b.unit_id AND a.run_id = 'A' AND b.run_id = 'R')
 SELECT region_id, count(*) AS n_units, round(avg(d), 6) + 0.0 AS mean_delta, round(avg(abs(d)), 6) AS mean_abs_delta,
 round(abs(avg(d)) / avg(abs(d)), 6) AS cancellation FROM dd JOIN um USING (unit_id)
 WHERE region_id IS NOT NULL GROUP BY region_id HAVING count(*) >= 3""")
def a37(spark, d):
    p = ship_panel(spark, d)
    out = P.region_contrast(p.where("run_id = 'A'"), p.where("run_id = 'R'"), unit_map(spark, d), 3)
    return out.select("region_id", "n_units", *[r(c).alias(c) for c in ("mean_delta", "mean_abs_delta", "cancellation")])


@query("a47_series_statistics", f"""WITH {ES} SELECT run_id, kind, count(*) AS samples, count(value) AS finite_samples,
 round(avg(value), 8) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min_value, max(value) AS max_value
 FROM es GROUP BY ALL""")
def a47(spark, d):
    v = F.col("value")
    return event_series(spark, d).groupBy("run_id", "kind").agg(
        F.count(F.lit(1)).alias("samples"), F.count(v).alias("finite_samples"), r(F.avg(v), 8).alias("mean"),
        r(F.stddev_pop(v)).alias("std"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
    )


@query("a21_column_statistics", """WITH x AS (SELECT unnest(['l_quantity','l_discount','l_tax']) AS feature,
 unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)
 SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min_value, max(v) AS max_value FROM x GROUP BY feature""")
def a21(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    long = table(spark, d, "lineitem").select(*names).unpivot([], names, "feature", "v")
    v = finite("v")
    return long.groupBy("feature").agg(
        r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"), F.min(v).alias("min_value"), F.max(v).alias("max_value")
    )


@query("p03_masked_units", f"WITH {SP}, {UM} SELECT run_id, count(*) AS cells, count(DISTINCT unit_id) AS units FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY run_id")
def p03(spark, d):
    return P.unmasked(ship_panel(spark, d), unit_map(spark, d)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("unit_id").alias("units")
    )


@query("p04_finite_only", f"""WITH {ES} SELECT run_id, count(*) AS cells,
 count(CASE WHEN value >= 50 THEN 1 END) AS finite_cells, round(avg(CASE WHEN value >= 50 THEN sqrt(value - 50) END), 8) AS mean_value
 FROM es GROUP BY run_id""")
def p04(spark, d):
    odd = event_series(spark, d).withColumn("value", F.sqrt(F.col("value") - 50))  # NaN below 50
    v = finite("value")
    return odd.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count(v).alias("finite_cells"), r(F.avg(v), 8).alias("mean_value")
    )


@query("p01_aligned_time", f"WITH {ES} SELECT row_key, round(CASE WHEN kind = 'view' THEN t ELSE t - 5 END, 6) AS stimulus_time, round(CASE WHEN kind = 'view' THEN t + 5 ELSE t END, 6) AS acquisition_time FROM es")
def p01(spark, d):
    aligned, offset = F.col("kind") == "view", 5.0
    return event_series(spark, d).select(
        "row_key",
        r(F.when(aligned, F.col("t")).otherwise(F.col("t") - offset)).alias("stimulus_time"),
        r(F.when(aligned, F.col("t") + offset).otherwise(F.col("t"))).alias("acquisition_time"),
    )


@query("p02_hemisphere_ranges", "SELECT CASE WHEN s_suppkey < (SELECT (count(*) + 1) // 2 FROM supplier) THEN 'left' ELSE 'right' END AS hemisphere, count(*) AS units, min(s_suppkey) AS first_unit, max(s_suppkey) AS last_unit FROM supplier GROUP BY 1")
def p02(spark, d):
    s = table(spark, d, "supplier")
    half = s.agg(F.floor((F.count(F.lit(1)) + 1) / 2).alias("half")).scalar()
    side = F.when(F.col("s_suppkey") < half, "left").otherwise("right")
    return s.groupBy(side.alias("hemisphere")).agg(
        F.count(F.lit(1)).alias("units"), F.min("s_suppkey").alias("first_unit"), F.max("s_suppkey").alias("last_unit")
    )


@query("p05_half_open_window", f"WITH {ES} SELECT run_id, count(*) AS samples, round(sum(value), 4) AS total FROM es WHERE t >= 1704672000 AND t < 1705276800 GROUP BY run_id")
def p05(spark, d):
    inside = event_series(spark, d).where((F.col("t") >= 1704672000.0) & (F.col("t") < 1705276800.0))
    return inside.groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"), r(F.sum("value"), 4).alias("total"))


@query("p06_closed_window", f"WITH {SP} SELECT run_id, count(*) AS cells, round(sum(value), 4) AS total FROM sp WHERE t BETWEEN 12 AND 24 GROUP BY run_id")
def p06(spark, d):
    return ship_panel(spark, d).where(F.col("t").between(12, 24)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cells"), r(F.sum("value"), 4).alias("total")
    )


@query("w01_consecutive_difference", f"WITH {ES} SELECT run_id, row_key, round(value - lag(value) OVER (PARTITION BY run_id ORDER BY t, row_key), 6) + 0.0 AS diff FROM es")
def w01(spark, d):
    es = event_series(spark, d)
    out = neighbours(es, ["run_id"], ["t", "row_key"], ["value"], chunk_width(es, ["run_id"], "t"))
    return out.select("run_id", "row_key", r(F.col("value") - F.col("prev.value")).alias("diff"))


PEAKS = """st AS (SELECT run_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM ix GROUP BY 1),
 nb AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM ix WINDOW w AS (PARTITION BY run_id ORDER BY t, row_key)),
 pk AS (SELECT nb.*, (value - m) / s AS score FROM nb JOIN st USING (run_id) WHERE n >= 3 AND value >= m + 1.5 * s
  AND value > pv AND value >= nv)"""


@query("w02_local_peaks", f"WITH {ES}, {ROWED}, {PEAKS} SELECT run_id, row_idx, row_key, value, round(score, 6) AS score FROM pk")
def w02(spark, d):
    ix, width = _indexed_events(spark, d)
    return P.local_peaks(ix, 1.5, width=width).select("run_id", "row_idx", "row_key", "value", r("score").alias("score"))


@query("w03_peak_suppression", f"""WITH RECURSIVE {ES}, {ROWED}, {PEAKS},
 o AS (SELECT run_id, row_idx, row_key, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, row_idx) AS k FROM pk),
 f AS (SELECT run_id, 1 AS k, [row_idx] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.run_id, o.k, CASE WHEN list_bool_and(list_transform(f.kept, lambda x: abs(x - o.row_idx) >= 6)) THEN list_append(f.kept, o.row_idx)
   ELSE f.kept END FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1),
 z AS (SELECT run_id, arg_max(kept, k) AS kept FROM f GROUP BY run_id)
 SELECT o.run_id, o.row_idx, o.row_key, o.value FROM o JOIN z USING (run_id) WHERE list_contains(z.kept, o.row_idx)""")
def w03(spark, d):
    ix, width = _indexed_events(spark, d)
    peaks = P.local_peaks(ix, 1.5, width=width)
    return P.suppress_close(peaks, 6).select("run_id", "row_idx", "row_key", "value")


DETECT = """l2 AS (SELECT run_id, row_idx, t, 'response_peak' AS event_type, sqrt(sum(value * value)) AS value
  FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY ALL),
 bo AS (SELECT * FROM l2 UNION ALL SELECT run_id, row_idx, t, 'large_transition', change_magnitude FROM ch),
 st AS (SELECT run_id, event_type, avg(value) AS m, stddev_pop(value) AS s FROM bo GROUP BY ALL),
 nb AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM bo WINDOW w AS (PARTITION BY run_id, event_type ORDER BY t)),
 pk AS (SELECT nb.*, (value - m) / s AS score FROM nb JOIN st USING (run_id, event_type)
  WHERE value >= m + 1.0 * s AND value > pv AND value >= nv),
 rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, event_type DESC, row_idx) AS event_rank FROM pk),
 tr AS (SELECT run_id, row_idx, region_id, row_number() OVER (PARTITION BY run_id, row_idx ORDER BY abs(value) DESC, region_id) AS k FROM rt),
 tn AS (SELECT run_id, row_idx, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY k) AS region_ids FROM tr WHERE k <= 3 GROUP BY ALL)"""


@query("w04_event_detection", f"""WITH {SP}, {UM}, {RT}, {CHANGE}, {DETECT} SELECT substr(sha256(event_type || ':' || row_idx || ':' || printf('%.1f', t)), 1, 16) AS event_key,
 run_id, event_type, row_idx, t, round(score, 6) AS score, event_rank, region_ids FROM rk JOIN tn USING (run_id, row_idx) WHERE event_rank <= 20""")
def w04(spark, d):
    p, um = durable(ship_panel(spark, d)), unit_map(spark, d)  # three passes over one written panel
    magnitude = P.global_metrics(p, um, median=False).withColumnRenamed("l2_magnitude", "value")
    change = P.change_magnitude(p, um).withColumnRenamed("change_magnitude", "value")
    out = P.detect_events(magnitude, change, P.region_means(p, um), z=1.0, min_distance=2)
    return out.withColumn("score", r("score")).withColumn(
        "region_ids", F.array_join(F.col("region_ids").cast("array<string>"), ",")
    )


@query("w27_change_markers", f"""WITH {ES}, s AS (SELECT run_id, row_key, t, abs(value - lag(value) OVER (PARTITION BY run_id ORDER BY t)) AS step FROM es),
 m AS (SELECT run_id, avg(step) + 0.5 * stddev_pop(step) AS cut FROM s GROUP BY 1),
 k AS (SELECT s.*, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, t) AS rank FROM s JOIN m USING (run_id) WHERE step >= cut)
 SELECT run_id, row_key, round(step, 6) AS step, rank FROM k WHERE rank <= 3""")
def w27(spark, d):
    es = event_series(spark, d)
    out = P.change_markers(es, width=chunk_width(es, ["run_id"], "t"))
    return out.select("run_id", "row_key", r("step").alias("step"), "rank")


@query("w15_trapezoid_integral", f"""WITH {ES}, p AS (SELECT run_id, kind, value, t, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM es
 WINDOW w AS (PARTITION BY run_id, kind ORDER BY t))
 SELECT run_id, kind, round(coalesce(sum((value + pv) / 2 * (t - pt)), 0), 3) AS integral, count(*) AS samples FROM p GROUP BY ALL""")
def w15(spark, d):
    es = event_series(spark, d)
    out = P.integral(es, ["run_id", "kind"], chunk_width(es, ["run_id", "kind"], "t"))
    return out.withColumn("integral", r("integral", 3))


@query("w29_step_change", f"""WITH {ES}, p AS (SELECT run_id, kind, abs(value - lag(value) OVER (PARTITION BY run_id, kind ORDER BY t)) AS s FROM es)
 SELECT run_id, kind, round(avg(s), 8) AS mean_abs_change, round(max(s), 6) AS max_step FROM p GROUP BY ALL""")
def w29(spark, d):
    es = event_series(spark, d)
    out = P.step_change(es, ["run_id", "kind"], chunk_width(es, ["run_id", "kind"], "t"))
    return out.withColumn("mean_abs_change", r("mean_abs_change", 8)).withColumn("max_step", r("max_step"))


@query("w28_robust_composite", f"""WITH {ES}, q AS (SELECT run_id, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.9) AS p90 FROM es GROUP BY 1)
 SELECT row_key, round(greatest(0, least(1, 0.5 * least(1, value / (p95 + 1e-9)) + 0.3 * (1 - least(1, value / (p90 + 1e-9))) +
 0.2 * greatest(0, 1 - abs(value / 100 - 0.5) / 0.5))), 6) AS activity FROM es JOIN q USING (run_id)""")
def w28(spark, d):
    es = event_series(spark, d)
    q = exact_quantiles(es, ["run_id"], "value", {"p95": 0.95, "p90": 0.90}, hot_rows=0)
    v = F.col("value")
    loud = F.least(F.lit(1.0), v / (F.col("p95") + 1e-9))
    flat = F.least(F.lit(1.0), v / (F.col("p90") + 1e-9))
    tri = F.greatest(F.lit(0.0), 1 - F.abs(v / 100 - 0.5) / 0.5)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * loud + 0.3 * (1 - flat) + 0.2 * tri))
    return es.join(q, "run_id").select("row_key", r(score).alias("activity"))


@query("k01_top_units", f"""WITH {SP}, k AS (SELECT run_id, row_idx, unit_id, value, row_number() OVER (PARTITION BY run_id, row_idx
 ORDER BY abs(value) DESC, unit_id) AS rank FROM sp) SELECT run_id, row_idx, unit_id, round(value, 6) AS value, rank FROM k WHERE rank <= 5""")
def k01(spark, d):
    out = P.top_per_row(ship_panel(spark, d), "unit_id", 5)
    return out.select("run_id", "row_idx", "unit_id", r("value").alias("value"), "rank")


@query("k02_top_regions", f"""WITH {SP}, {UM}, {RT}, k AS (SELECT run_id, row_idx, region_id, value, row_number() OVER (PARTITION BY run_id, row_idx
 ORDER BY abs(value) DESC, region_id) AS rank FROM rt) SELECT run_id, row_idx, region_id, round(value, 6) AS value, rank FROM k WHERE rank <= 3""")
def k02(spark, d):
    out = P.top_per_row(_regions(spark, d), "region_id", 3)
    return out.select("run_id", "row_idx", "region_id", r("value").alias("value"), "rank")


@query("k03_top_events", f"""WITH {ES}, k AS (SELECT run_id, row_key, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, row_key) AS rank FROM es)
 SELECT * FROM k WHERE rank <= 3""")
def k03(spark, d):
    out = top_k(event_series(spark, d), ["run_id"], [F.col("value").desc(), F.col("row_key")], 3)
    return out.select("run_id", "row_key", "value", "rank")


@query("k05_dominant_samples", f"""WITH {ES}, k AS (SELECT run_id, t, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, t) AS k FROM es)
 SELECT run_id, round(t, 6) AS t, value, row_number() OVER (PARTITION BY run_id ORDER BY t) AS position FROM k WHERE k <= 3""")
def k05(spark, d):
    best = top_k(event_series(spark, d), ["run_id"], [F.col("value").desc(), F.col("t")], 3)
    again = top_k(best.select("run_id", "t", "value"), ["run_id"], [F.col("t")], 3, "position")
    return again.withColumn("t", r("t"))


@query("e01_panel_analytics", f"""WITH {SP}, {UM}, {RT}, {CHANGE},
 g AS (SELECT run_id, row_idx, t, avg(value) AS mean, sqrt(sum(value * value)) AS l2, sqrt(avg(value * value)) AS rms,
  avg(value) FILTER (hemisphere = 'left') - avg(value) FILTER (hemisphere = 'right') AS lr,
  sum(value * value) AS s2, sum(abs(value)) AS s1, count(*) AS n FROM sp JOIN um USING (unit_id) WHERE NOT excluded GROUP BY ALL)
 SELECT run_id, row_idx, t, round(mean, 6) AS mean, round(l2, 6) AS l2_magnitude, round(rms, 6) AS rms_magnitude, round(lr, 6) + 0.0 AS left_minus_right,
 round((s2 / (s1 * s1) - 1.0::DOUBLE / n) / (1 - 1.0::DOUBLE / n), 8) AS concentration, round(change_magnitude, 6) AS change_magnitude,
 round(top_value, 6) AS top_region_value, top_region
 FROM g JOIN ch USING (run_id, row_idx, t) JOIN (SELECT run_id, row_idx, arg_max(region_id, struct_pack(a := abs(value), b := -region_id)) AS top_region,
  arg_max(value, struct_pack(a := abs(value), b := -region_id)) AS top_value FROM rt GROUP BY ALL) USING (run_id, row_idx)""")
def e01(spark, d):
    """Everything per step for all runs at once: one pass over the panel per grouping."""
    p, um = durable(ship_panel(spark, d)), unit_map(spark, d)
    cells = P.unmasked(p, um)
    v = F.col("value")
    n = F.count(v)
    s1, s2 = F.sum(F.abs(v)), F.sum(v * v)
    side = lambda name: F.avg(F.when(F.col("hemisphere") == name, v))
    per_row = cells.groupBy(*P.ROW).agg(
        r(F.avg(v)).alias("mean"), r(F.sqrt(s2)).alias("l2_magnitude"), r(F.sqrt(F.avg(v * v))).alias("rms_magnitude"),
        r(side("left") - side("right")).alias("left_minus_right"),
        r((safe_div(s2, s1 * s1) - 1 / n) / (1 - 1 / n), 8).alias("concentration"),
    )
    change = P.change_magnitude(p, um).withColumn("change_magnitude", r("change_magnitude"))
    key = F.struct(F.abs("value"), -F.col("region_id"))
    top = P.region_means(p, um).groupBy("run_id", "row_idx").agg(
        F.max_by("region_id", key).alias("top_region"), r(F.max_by("value", key)).alias("top_region_value")
    )
    return per_row.join(change, P.ROW).join(top, ["run_id", "row_idx"])
