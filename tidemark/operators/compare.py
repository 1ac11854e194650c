"""Variant comparison: alignment, differences, ranked divergence, comparability gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, pearson, safe_div
from tidemark.operators.panel import ordered_list
from tidemark.operators.ranks import ranked, top_k
from tidemark.operators.sequence import chunk_width, ordinal, running
from tidemark.operators.timejoin import asof, tolerance_join

PAIR = ["ref_run", "cand_run"]


def align_rows(
    rows: DataFrame, pairs: DataFrame, tolerance: float, bucket: float | None = None
) -> DataFrame:
    """Aligned rows of every (reference, candidate) pair of runs.

    ``rows`` is ``run_id, row_idx, t`` (one line per time step), ``pairs`` is
    ``ref_run, cand_run``. Returns ``ref_row, cand_row, t`` and the ambiguity flag.
    """
    ref = rows.select(
        F.col("run_id").alias("ref_run"), F.col("row_idx").alias("ref_row"), F.col("t").alias("ref_t")
    ).join(pairs, "ref_run")
    cand = rows.select(
        F.col("run_id").alias("cand_run"), F.col("row_idx").alias("cand_row"), F.col("t").alias("cand_t")
    ).join(pairs, "cand_run")
    return tolerance_join(ref, cand, PAIR, "ref_t", "cand_t", tolerance, bucket)


def difference(aligned: DataFrame, cells: DataFrame, key: str = "unit_id") -> DataFrame:
    """Candidate minus reference for every aligned row and unit (or region).

    Cells where either side is missing or not finite have a NULL delta and are kept.
    """
    v = finite("value")
    ref = cells.select(
        F.col("run_id").alias("ref_run"), F.col("row_idx").alias("ref_row"), key, v.alias("ref_value")
    )
    cand = cells.select(
        F.col("run_id").alias("cand_run"), F.col("row_idx").alias("cand_row"), key, v.alias("cand_value")
    )
    spine = aligned.select(*PAIR, "ref_row", "cand_row", "t")
    return (
        spine.join(ref, ["ref_run", "ref_row"])
        .join(cand, ["cand_run", "cand_row", key])
        .withColumn("delta", F.col("cand_value") - F.col("ref_value"))
    )


def row_differences(delta: DataFrame) -> DataFrame:
    """Per aligned row: L2, RMS (per jointly finite cell), means, cosine and the cell count."""
    d = F.col("delta")
    x = F.when(d.isNotNull(), F.col("ref_value"))
    y = F.when(d.isNotNull(), F.col("cand_value"))
    return delta.groupBy(*PAIR, "ref_row", "cand_row", "t").agg(
        F.sqrt(F.sum(d * d)).alias("l2"),
        F.sqrt(F.avg(d * d)).alias("rms"),
        F.avg(d).alias("mean_delta"),
        F.avg(F.abs(d)).alias("mean_abs_delta"),
        safe_div(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("cosine"),
        F.count(d).alias("finite_count"),
    )


def hemisphere_differences(delta: DataFrame, unit_map: DataFrame) -> DataFrame:
    sides = unit_map.where(~F.col("excluded")).select("unit_id", "hemisphere")
    side = lambda n: F.avg(F.when(F.col("hemisphere") == n, F.col("delta")))
    return delta.join(sides, "unit_id").groupBy(*PAIR, "t").agg(
        side("left").alias("left_delta"),
        side("right").alias("right_delta"),
        (side("left") - side("right")).alias("left_minus_right"),
    )


def difference_summary(delta: DataFrame, key: str) -> DataFrame:
    """Per region or network: mean signed, mean absolute, RMS and the largest difference."""
    d = F.col("delta")
    best = F.max_by(F.struct("delta", "t"), F.when(d.isNotNull(), F.struct(F.abs(d), -F.col("t"))))
    return (
        delta.groupBy(*PAIR, key)
        .agg(
            F.avg(d).alias("mean_signed_delta"),
            F.avg(F.abs(d)).alias("mean_absolute_delta"),
            F.sqrt(F.avg(d * d)).alias("rms_delta"),
            best.alias("_b"),
        )
        .withColumn("peak_absolute_delta", F.abs("_b.delta"))
        .withColumn("peak_signed_delta", F.col("_b.delta"))
        .withColumn("peak_time", F.col("_b.t"))
        .drop("_b")
    )


def alignment_coverage(aligned: DataFrame, rows: DataFrame) -> DataFrame:
    """Aligned rows and the fraction of each side they cover."""
    sizes = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    ref = sizes.select(F.col("run_id").alias("ref_run"), F.col("n").alias("reference_samples"))
    cand = sizes.select(F.col("run_id").alias("cand_run"), F.col("n").alias("candidate_samples"))
    return (
        aligned.groupBy(*PAIR)
        .agg(
            F.count(F.lit(1)).alias("aligned_samples"),
            F.countDistinct("cand_row").alias("_used"),
            F.min("t").alias("first_time"),
            F.max("t").alias("last_time"),
        )
        .join(ref, "ref_run")
        .join(cand, "cand_run")
        .withColumn("reference_fraction", F.col("aligned_samples") / F.col("reference_samples"))
        .withColumn("candidate_fraction", F.col("_used") / F.col("candidate_samples"))
        .drop("_used")
    )


def rank_divergence(
    rows: DataFrame, radius: int = 1, max_events: int = 20, width: float | None = None
) -> DataFrame:
    """Divergence events: largest RMS first, skipping rows within ``2 * radius`` of a chosen one.

    A chosen row can rule out at most ``4 * radius`` others, so the best
    ``max_events * (4 * radius + 1)`` rows of a pair always hold the answer. Only that
    bounded shortlist is decided in Python.
    """
    placed = ordinal(rows, PAIR, ["t"], "aligned_index", width).where("rms > 0")
    short = top_k(
        placed, PAIR, [F.col("rms").desc(), F.col("aligned_index")], max_events * (4 * radius + 1), "_k"
    ).drop("_k")
    schema = short.withColumn("event_rank", F.lit(1)).schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["rms", "aligned_index"], ascending=[False, True])
        chosen: list[int] = []
        keep: list[int] = []
        for pos, index in zip(ordered.index, ordered["aligned_index"], strict=True):
            if len(chosen) == max_events:
                break
            if all(abs(int(index) - c) > 2 * radius for c in chosen):
                chosen.append(int(index))
                keep.append(pos)
        return ordered.loc[keep].assign(event_rank=np.arange(1, len(keep) + 1, dtype=np.int32))

    return short.groupBy(*PAIR).applyInPandas(pick, schema)


def rank_windows(
    events: DataFrame, rows: DataFrame, radius: int = 1, width: float | None = None
) -> DataFrame:
    """Windows of ``radius`` rows around each event, ranked by mean RMS then start."""
    placed = ordinal(rows, PAIR, ["t"], "aligned_index", width)
    spots = events.select(
        *PAIR,
        F.col("aligned_index").alias("centre"),
        F.explode(
            F.sequence(F.col("aligned_index") - radius, F.col("aligned_index") + radius)
        ).alias("aligned_index"),
    )
    covered = spots.join(placed, [*PAIR, "aligned_index"])
    windows = covered.groupBy(*PAIR, "centre").agg(
        F.min("t").alias("start_time"),
        F.max("t").alias("end_time"),
        F.count(F.lit(1)).alias("samples"),
        F.avg("l2").alias("mean_l2"),
        F.avg("rms").alias("mean_rms"),
        F.max("rms").alias("peak_rms"),
        F.max_by("l2", F.struct("rms", -F.col("aligned_index"))).alias("peak_l2"),
        F.max_by("t", F.struct("rms", -F.col("aligned_index"))).alias("peak_time"),
    )
    distinct = windows.dropDuplicates([*PAIR, "start_time", "end_time"])
    order = [F.col("mean_rms").desc(), F.col("start_time")]
    return ranked(distinct.drop("centre"), PAIR, [*order, F.col("end_time")], "window_rank")


def comparability(manifests: DataFrame, pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every declared field that differs between the two runs of a pair (null-safe)."""
    text = lambda f: F.col(f).cast("string")
    ref = manifests.select(F.col("run_id").alias("ref_run"), *[text(f).alias(f"r_{f}") for f in fields])
    cand = manifests.select(F.col("run_id").alias("cand_run"), *[text(f).alias(f"c_{f}") for f in fields])
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("ref"), F.col(f"c_{f}").alias("cand"))
            for f in fields
        ]
    )
    joined = pairs.join(ref, "ref_run").join(cand, "cand_run")
    return (
        joined.select(*PAIR, F.explode(entries).alias("e"))
        .where(~F.col("e.ref").eqNullSafe(F.col("e.cand")))
        .select(*PAIR, "e.field", F.col("e.ref").alias("ref_value"), F.col("e.cand").alias("cand_value"))
    )


def gated(ref: Column, cand: Column, ref_mask: Column | None = None, cand_mask: Column | None = None) -> Column:
    """Candidate minus reference, only where both are finite and both masks exceed 0.5."""
    ok = finite(ref).isNotNull() & finite(cand).isNotNull()
    if ref_mask is not None and cand_mask is not None:
        ok = ok & (ref_mask > 0.5) & (cand_mask > 0.5)
    return F.when(ok, cand - ref)


def feature_differences(paired: DataFrame, features: dict[str, str | None]) -> DataFrame:
    """Long ``feature, delta`` over aligned feature rows; ``features`` maps a name to its mask.

    Columns come as ``ref_<name>`` and ``cand_<name>``.
    """
    def one(name: str, mask: str | None) -> Column:
        masks = (F.col(f"ref_{mask}"), F.col(f"cand_{mask}")) if mask else ()
        return F.struct(
            F.lit(name).alias("feature"), gated(F.col(f"ref_{name}"), F.col(f"cand_{name}"), *masks).alias("delta")
        )

    cells = F.array(*[one(n, m) for n, m in features.items()])
    return paired.select(*PAIR, "t", F.explode(cells).alias("c")).select(*PAIR, "t", "c.feature", "c.delta")


def feature_difference_summary(delta: DataFrame) -> DataFrame:
    """Share of rows with a usable delta, mean signed and mean absolute over those."""
    d = F.col("delta")
    return delta.groupBy(*PAIR, "feature").agg(
        F.avg(F.when(d.isNotNull(), 1.0).otherwise(0.0)).alias("coverage_fraction"),
        F.avg(d).alias("mean_signed_delta"),
        F.avg(F.abs(d)).alias("mean_absolute_delta"),
    )


def lagged_correlations(
    features: DataFrame,
    feature_names: Sequence[str],
    metrics: DataFrame,
    metric_names: Sequence[str],
    lags: Sequence[float],
    min_samples: int = 8,
    width: float | None = None,
) -> DataFrame:
    """Pearson of every feature, metric and lag: ``run_id, feature, metric, lag, n, correlation``.

    Features (``run_id, t, ...``) are interpolated at ``t - lag`` of each metric row, never
    beyond their own range. One as-of pass serves all features and metrics.
    """
    targets = metrics.select(
        "run_id",
        F.struct(*[F.col(m).cast("double").alias(m) for m in metric_names]).alias("m"),
        F.explode(
            F.array(*[F.struct(F.lit(float(g)).alias("lag"), (F.col("t") - F.lit(float(g))).alias("tt")) for g in lags])
        ).alias("l"),
    ).select("run_id", "m", "l.lag", "l.tt")
    clean = features.select("run_id", "t", *[finite(f).alias(f) for f in feature_names])
    both = asof(targets, clean, ["run_id"], "tt", "t", ["t", *feature_names], width)
    gap = F.col("hi.t") - F.col("lo.t")
    w = F.when(gap > 0, (F.col("tt") - F.col("lo.t")) / gap).otherwise(F.lit(0.0))
    inside = both.where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    fx = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.col(f"lo.{f}") + (F.col(f"hi.{f}") - F.col(f"lo.{f}")) * w).alias("x"),
            )
            for f in feature_names
        ]
    )
    fy = F.array(
        *[F.struct(F.lit(m).alias("metric"), finite(F.col(f"m.{m}")).alias("y")) for m in metric_names]
    )
    long = inside.select("run_id", "lag", F.explode(fx).alias("fx"), fy.alias("fy")).select(
        "run_id", "lag", "fx.feature", "fx.x", F.explode("fy").alias("fy")
    )
    cells = long.select("run_id", "lag", "feature", "x", "fy.metric", "fy.y").where(
        "x IS NOT NULL AND y IS NOT NULL"
    )
    x, y = F.col("x"), F.col("y")
    n = F.count(F.lit(1)).cast("double")
    sums = cells.groupBy("run_id", "feature", "metric", "lag").agg(
        F.count(F.lit(1)).alias("n"),
        pearson(n, F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)).alias("correlation"),
    )
    return sums.where((F.col("n") >= min_samples) & F.col("correlation").isNotNull())


def best_lag(tests: DataFrame) -> DataFrame:
    """Strongest lag per pair (first lag wins ties on the rounded coefficient)."""
    key = F.struct(F.abs(F.round("correlation", 4)), -F.col("lag"))
    return tests.groupBy("run_id", "feature", "metric").agg(
        F.max_by(F.struct("lag", "n", "correlation"), key).alias("b"), F.count(F.lit(1)).alias("lags_tested")
    ).select("run_id", "feature", "metric", "lags_tested", "b.*")


def multiplicity(tests: DataFrame, family: Sequence[str], p: str = "p_value") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjustment over every test of a family.

    Distinct p-values are counted first, so the ordered pass sees each value once; a large family
    is passed in chunks.
    """
    family = list(family)
    counts = tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*family).agg(F.sum("_c").alias("_m"))
    width = chunk_width(counts, family, p)
    stepped = running(counts, family, [p], {"_rank": ("sum", "_c")}, width).join(total, family)
    stepped = stepped.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    adjusted = running(stepped, family, [p], {"_low": ("min", "_q")}, width, reverse=True)
    adjusted = adjusted.withColumn("q_value", F.least(F.lit(1.0), F.col("_low")))
    out = tests.join(adjusted.select(*family, p, "_m", "q_value"), [*family, p])
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).withColumnRenamed(
        "_m", "comparisons"
    )


def region_ranking(summary: DataFrame, key: str, limit: int) -> DataFrame:
    order = [F.col("mean_absolute_delta").desc(), F.col(key)]
    return top_k(summary, PAIR, order, limit, "position")


def top_regions_of(events: DataFrame, region_delta: DataFrame, top: int = 5) -> DataFrame:
    """Regions with the largest difference at each event's row."""
    at = region_delta.where(F.col("delta").isNotNull()).join(
        events.select(*PAIR, "ref_row").distinct(), [*PAIR, "ref_row"], "left_semi"
    )
    best = top_k(at, [*PAIR, "ref_row"], [F.abs("delta").desc(), F.col("region_id")], top)
    ids = best.groupBy(*PAIR, "ref_row").agg(ordered_list("rank", "region_id").alias("top_region_ids"))
    return events.join(ids, [*PAIR, "ref_row"], "left")
