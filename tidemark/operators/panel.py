"""Panel analytics: region roll-ups, global metrics, change, peaks and profiles.

A panel is long: ``run_id, row_idx, t, unit_id, value`` where ``row_idx`` is the dense row
number in the run and ``t`` its own time (rows are not evenly spaced). All functions take
any number of runs at once. ``unit_map`` is ``unit_id, region_id, network_id, hemisphere,
excluded``; its size is left to the planner, which broadcasts it only when small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, pearson, safe_div, stable_id
from tidemark.operators.products import pair_sums
from tidemark.operators.ranks import HOT_ROWS, exact_quantiles, largest_group, top_k
from tidemark.operators.sequence import neighbours
from tidemark.session import durable

ROW = ["run_id", "row_idx", "t"]


def unmasked(panel: DataFrame, unit_map: DataFrame) -> DataFrame:
    """Panel cells of units that are not excluded, non-finite cells as NULL."""
    keep = unit_map.where(~F.col("excluded"))
    return panel.join(keep, "unit_id").withColumn("value", finite("value"))


def region_means(panel: DataFrame, unit_map: DataFrame, level: str = "region_id") -> DataFrame:
    """Mean of finite cells per step and region (or network)."""
    mapped = unit_map.where(F.col(level).isNotNull()).select("unit_id", level)
    return panel.join(mapped, "unit_id").groupBy(*ROW, level).agg(F.avg(finite("value")).alias("value"))


def hemisphere_means(panel: DataFrame, unit_map: DataFrame) -> DataFrame:
    cells = unmasked(panel, unit_map)
    side = lambda name: F.avg(F.when(F.col("hemisphere") == name, F.col("value")))
    return cells.groupBy(*ROW).agg(
        side("left").alias("left_mean"),
        side("right").alias("right_mean"),
        (side("left") - side("right")).alias("left_minus_right"),
    )


def global_metrics(panel: DataFrame, unit_map: DataFrame, median: bool = True) -> DataFrame:
    """Mean, median, population sd and variance, L2 and RMS over units, per step."""
    cells = unmasked(panel, unit_map)
    v = F.col("value")
    # A step of ordinary size takes its median in the same pass as everything else.
    in_pass = median and largest_group(cells, ["run_id", "row_idx"]) <= HOT_ROWS
    out = cells.groupBy(*ROW).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("spatial_variance"),
        F.sqrt(F.sum(v * v)).alias("l2_magnitude"),
        F.sqrt(F.avg(v * v)).alias("rms_magnitude"),
        *([F.median(v).alias("median")] if in_pass else []),
    )
    if in_pass or not median:
        return out
    mid = exact_quantiles(cells, ["run_id", "row_idx"], "value", {"median": 0.5})
    return out.join(mid, ["run_id", "row_idx"], "left")


def change_magnitude(
    panel: DataFrame, unit_map: DataFrame | None = None, width: float | None = None
) -> DataFrame:
    """L2 over units of the difference from the row before; zero on a run's first row."""
    cells = panel.withColumn("value", finite("value"))
    if unit_map is not None:
        cells = unmasked(panel, unit_map)
    stepped = neighbours(cells, ["run_id", "unit_id"], ["t"], ["row_idx", "value"], width)
    adjacent = F.col("prev.row_idx") == F.col("row_idx") - 1
    delta = F.when(adjacent, F.col("value") - F.col("prev.value"))
    return stepped.groupBy(*ROW).agg(
        F.when(F.col("row_idx") == 0, F.lit(0.0))
        .otherwise(F.sqrt(F.sum(delta * delta)))
        .alias("change_magnitude")
    )


def spatial_concentration(panel: DataFrame, unit_map: DataFrame) -> DataFrame:
    """Normalised Herfindahl index of absolute values: 0 even, 1 on a single unit."""
    cells = unmasked(panel, unit_map)
    v = F.col("value")
    return (
        cells.groupBy(*ROW)
        .agg(F.sum(v * v).alias("_s2"), F.sum(F.abs(v)).alias("_s1"), F.count(v).alias("_n"))
        .select(
            *ROW,
            F.when((F.col("_n") <= 1) | (F.col("_s1") == 0), F.lit(0.0))
            .otherwise(
                (F.col("_s2") / (F.col("_s1") * F.col("_s1")) - F.lit(1.0) / F.col("_n"))
                / (F.lit(1.0) - F.lit(1.0) / F.col("_n"))
            )
            .alias("concentration"),
        )
    )


def series_summary(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population sd, min, max and the signed value of largest magnitude with its place."""
    v = F.col("value")
    peak = F.max_by(
        F.struct("value", "row_idx", "t"), F.when(v.isNotNull(), F.struct(F.abs(v), -F.col("row_idx")))
    )
    return (
        series.groupBy(*keys)
        .agg(
            F.avg(v).alias("mean_response"),
            F.stddev_pop(v).alias("std_response"),
            F.min(v).alias("min_response"),
            F.max(v).alias("max_response"),
            peak.alias("_p"),
        )
        .select(
            *keys,
            "mean_response",
            "std_response",
            "min_response",
            "max_response",
            F.col("_p.value").alias("peak_response"),
            F.col("_p.row_idx").alias("peak_timestep"),
            F.col("_p.t").alias("peak_time"),
        )
    )


def correlation_matrix(series: DataFrame, key: str) -> DataFrame:
    """Pairwise-complete Pearson matrix between the series of a run (upper triangle).

    Series are multiplied in blocks, so only the R x R sums leave a task.
    """
    sums = pair_sums(series.where(F.col("value").isNotNull()), ["run_id"], key, "row_idx")
    correlation = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.select("run_id", f"{key}_a", f"{key}_b", correlation.alias("correlation"), F.col("n").cast("long").alias("n_pairs"))


def temporal_similarity(series: DataFrame, key: str) -> DataFrame:
    """Cosine between the patterns of any two rows of a run (upper triangle), in blocks of rows."""
    sums = pair_sums(series, ["run_id"], "row_idx", key)
    length = F.sqrt("sxx") * F.sqrt("syy")
    return sums.select("run_id", F.col("row_idx_a").alias("row_a"), F.col("row_idx_b").alias("row_b"), safe_div(F.col("sxy"), length).alias("cosine"))


def window_summary(
    panel: DataFrame, unit_map: DataFrame, start: float, end: float, top: int = 5
) -> DataFrame:
    """Closed window ``[start, end]``: mean, mean L2, largest change, peak row, top regions."""
    inside = panel.where(F.col("t").between(start, end))
    v = finite("value")
    cells = inside.select(*ROW, "unit_id", v.alias("value"))
    per_row = cells.groupBy(*ROW).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"),
        F.sum("value").alias("_sum"),
        F.count("value").alias("_n"),
    )
    # The first row of the window has no predecessor inside it.
    stepped = neighbours(cells, ["run_id", "unit_id"], ["t"], ["row_idx", "value"])
    d = F.when(F.col("prev.row_idx") == F.col("row_idx") - 1, F.col("value") - F.col("prev.value"))
    change = stepped.groupBy("run_id", "row_idx").agg(F.sqrt(F.sum(d * d)).alias("_change"))
    rows = per_row.join(change, ["run_id", "row_idx"], "left")
    facts = rows.groupBy("run_id").agg(
        F.min("t").alias("start_time"),
        F.max("t").alias("end_time"),
        (F.sum("_sum") / F.sum("_n")).alias("mean_response"),
        F.avg("l2").alias("mean_magnitude"),
        F.coalesce(F.max("_change"), F.lit(0.0)).alias("largest_change"),
        F.max_by("row_idx", F.struct("l2", -F.col("row_idx"))).alias("peak_timestep"),
    )
    means = region_means(inside, unit_map).groupBy("run_id", "region_id").agg(F.avg("value").alias("m"))
    best = top_k(means, ["run_id"], [F.abs("m").desc(), F.col("region_id")], top)
    ids = best.groupBy("run_id").agg(ordered_list("rank", "region_id").alias("top_region_ids"))
    return facts.join(ids, "run_id", "left")


def ordered_list(by: str, value: str) -> Column:
    """Values of a bounded group in the order of ``by``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def top_per_row(series: DataFrame, key: str, k: int) -> DataFrame:
    """Top ``k`` units or regions of every row by magnitude, missing last."""
    order = [F.abs("value").desc_nulls_last(), F.col(key)]
    return top_k(series, ["run_id", "row_idx"], order, k)


def local_peaks(
    series: DataFrame, z: float = 1.5, keys: Sequence[str] = ("run_id",), width: float | None = None
) -> DataFrame:
    """Interior local maxima at or above mean + z sd of their own series; score = z value.

    Needs ``row_idx, t, value``; a series below three rows has none.
    """
    keys = list(keys)
    v = F.col("value")
    stats = series.groupBy(*keys).agg(
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"), F.count(F.lit(1)).alias("_n")
    )
    near = neighbours(series, keys, ["t"], ["value"], width, lead=True)
    peak = (
        (F.col("_n") >= 3)
        & (v >= F.col("_mean") + z * F.col("_sd"))
        & (v > F.col("prev.value"))
        & (v >= F.col("next.value"))
    )
    score = F.when(F.col("_sd") > 0, (v - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return near.join(stats, keys).where(peak).select(*series.columns, score.alias("score"))


SUPPRESS_ROWS = 100_000  # row positions that one task of the suppression spans, at least the distance
_UNDECIDED, _KEPT, _DROPPED = 0, 1, 2


def _settle(row: np.ndarray, value: np.ndarray, status: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """Decide what can be decided here: highest value first, ties to the earlier row.

    A row is dropped next to a kept one and kept when nothing higher beside it is undecided. Rows
    that are not ``own`` stay as they came. One pass is enough, since a decision waits for higher
    rows only.
    """
    place = np.lexsort((value, row))
    row, value, status, own = row[place], value[place], status[place].copy(), own[place]
    low = np.searchsorted(row, row - distance, side="right")
    high = np.searchsorted(row, row + distance, side="left")
    for i in np.lexsort((row, -value)):
        if not own[i] or status[i]:
            continue
        near = status[low[i] : high[i]]
        if (near == _KEPT).any():
            status[i] = _DROPPED
            continue
        open_rows = np.flatnonzero(near == _UNDECIDED) + low[i]
        higher = (value[open_rows] > value[i]) | ((value[open_rows] == value[i]) & (row[open_rows] < row[i]))
        if not higher.any():
            same = open_rows[(open_rows != i) & (row[open_rows] == row[i]) & (value[open_rows] == value[i])]
            status[same] = _DROPPED  # of equal rows one stays
            status[i] = _KEPT
    out = np.empty_like(status)
    out[place] = status
    return out


def suppress_close(peaks: DataFrame, min_distance: int, keys: Sequence[str] = ("run_id",), span: int = SUPPRESS_ROWS) -> DataFrame:
    """Greedy minimum-distance suppression: higher values win, ties to the earlier row.

    Exact for chains of any length: row positions are cut into spans, each span decides all that
    does not hang on an undecided higher peak beyond its border, and only peaks within the
    distance of a border go to the neighbouring span in the next round. A round is one job over
    what is still undecided; with values in no particular order two or three suffice, values that
    rise over many spans need a round for each span they rise over. No task holds more than a
    span and two distances of positions.
    """
    keys = list(keys)
    span = max(int(span), int(min_distance))
    if min_distance <= 0:
        return peaks
    columns = peaks.columns
    placed = durable(peaks.withColumn("_peak", F.monotonically_increasing_id()))
    slim = placed.select(*keys, "_peak", F.col("row_idx").cast("long").alias("_row"), F.col("value").cast("double").alias("_value"))
    state = slim.select("*", F.lit(_UNDECIDED).alias("_status"), F.floor(F.col("_row") / span).cast("long").alias("_span"))
    schema = state.schema

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["_span"] == pdf["_home"]).to_numpy()
        status = _settle(pdf["_row"].to_numpy(), pdf["_value"].to_numpy(), pdf["_status"].to_numpy(), own, min_distance)
        return pdf.assign(_status=status)[own][schema.names]

    kept: list[DataFrame] = []
    while True:
        offset = F.col("_row") - F.col("_span") * span
        sides = F.filter(
            F.array(F.col("_span"), F.when(offset < min_distance, F.col("_span") - 1), F.when(offset >= span - min_distance, F.col("_span") + 1)),
            lambda x: x.isNotNull(),
        )
        spread = state.withColumn("_at", F.explode(sides)).withColumnRenamed("_span", "_home").withColumnRenamed("_at", "_span")
        found = spread.groupBy(*keys, "_span").applyInPandas(decide, schema)
        found = durable(found.where(F.col("_status") != _DROPPED))
        kept.append(found.where(F.col("_status") == _KEPT).select("_peak"))
        if found.where(F.col("_status") == _UNDECIDED).isEmpty():
            break
        # What is kept matters on from here only beside a border; it is settled and is not decided again.
        border = (offset < min_distance) | (offset >= span - min_distance)
        state = found.where((F.col("_status") == _UNDECIDED) | border)
    return placed.join(reduce(DataFrame.unionByName, kept).distinct(), "_peak", "left_semi").select(*columns)


def detect_events(
    magnitude: DataFrame,
    change: DataFrame,
    regions: DataFrame,
    z: float = 1.5,
    min_distance: int = 2,
    max_events: int = 20,
    width: float | None = None,
) -> DataFrame:
    """Response peaks and large transitions with their top three regions, best ``max_events``."""
    both = magnitude.select(*ROW, F.lit("response_peak").alias("event_type"), "value").unionByName(
        change.select(*ROW, F.lit("large_transition").alias("event_type"), "value")
    )
    peaks = local_peaks(both, z, ["run_id", "event_type"], width)
    # Two local peaks are never adjacent, so a distance of two or less suppresses nothing.
    kept = suppress_close(peaks, min_distance, ["run_id", "event_type"]) if min_distance > 2 else peaks
    order = [F.col("score").desc(), F.col("event_type").desc(), F.col("row_idx")]
    best = top_k(kept, ["run_id"], order, max_events, "event_rank")
    top = top_per_row(
        regions.join(best.select("run_id", "row_idx").distinct(), ["run_id", "row_idx"], "left_semi"),
        "region_id",
        3,
    )
    names = top.groupBy("run_id", "row_idx").agg(ordered_list("rank", "region_id").alias("region_ids"))
    return best.join(names, ["run_id", "row_idx"], "left").select(
        stable_id(F.col("event_type"), F.col("row_idx").cast("string"), F.format_string("%.1f", "t")).alias(
            "event_key"
        ),
        "run_id",
        "event_type",
        "row_idx",
        "t",
        "score",
        "event_rank",
        "region_ids",
    )


def change_markers(
    series: DataFrame, sd_factor: float = 0.5, top: int = 3, keys: Sequence[str] = ("run_id",),
    width: float | None = None,
) -> DataFrame:
    """Largest steps at or above mean + factor x sd of all steps, at most ``top`` per run."""
    keys = list(keys)
    stepped = neighbours(series, keys, ["t"], ["value"], width).withColumn(
        "step", F.abs(F.col("value") - F.col("prev.value"))
    ).where(F.col("step").isNotNull()).drop("prev")
    stats = stepped.groupBy(*keys).agg(
        F.avg("step").alias("_m"), F.stddev_pop("step").alias("_s")
    )
    strong = stepped.join(stats, keys).where(F.col("step") >= F.col("_m") + sd_factor * F.col("_s"))
    return top_k(strong.drop("_m", "_s"), keys, [F.col("step").desc(), F.col("t")], top)


def health_profile(panel: DataFrame) -> DataFrame:
    """Per-run counts of NaN, infinite and finite cells, spread, percentiles, constant units."""
    raw = F.col("value").cast("double")
    v = finite("value")
    facts = panel.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.when(F.isnan(raw), 1).otherwise(0)).alias("nan_cells"),
        F.sum(F.when(F.abs(raw) == float("inf"), 1).otherwise(0)).alias("inf_cells"),
        F.count(v).alias("finite_cells"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.stddev_pop(v).alias("std_value"),
    )
    units = (
        panel.groupBy("run_id", "unit_id")
        .agg(F.var_pop(v).alias("var"))
        .groupBy("run_id")
        .agg(
            F.sum(F.when(F.col("var") == 0, 1).otherwise(0)).alias("constant_units"),
            F.avg("var").alias("mean_unit_variance"),
        )
    )
    q = exact_quantiles(
        panel.select("run_id", v.alias("value")), ["run_id"], "value",
        {"p01": 0.01, "p50": 0.50, "p99": 0.99},
    )
    return facts.join(units, "run_id").join(q, "run_id", "left")


def timeline_summary(
    rows: DataFrame, step: float, tolerance: float = 1e-6, width: float | None = None
) -> DataFrame:
    """Per run: rows kept, first and last time, covered seconds, largest gap, contiguous or not."""
    gaps = neighbours(rows, ["run_id"], ["t"], ["t"], width).withColumn(
        "gap", F.col("t") - F.col("prev.t")
    )
    return gaps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("kept"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        (F.count(F.lit(1)) * F.lit(step)).alias("covered_seconds"),
        F.max("gap").alias("largest_gap"),
        F.coalesce(F.bool_and(F.abs(F.col("gap") - step) <= tolerance), F.lit(True)).alias("contiguous"),
    )


def timeline_coverage(
    segments: DataFrame, step: float, offset: float = 0.0, tolerance: float = 1e-6, width: float | None = None
) -> DataFrame:
    """Per run: kept of all segments, first start, last end, seconds covered, contiguous or not, notes.

    ``segments`` has ``run_id, start_t, duration, kept``. Seconds covered are the sum of the
    kept durations. Note ``before_start``: a kept start less ``offset`` is negative; ``tiled``:
    segments were left out and yet the kept ones fill their span. A run without kept segments
    is contiguous, with null times; segments without a start or duration are not kept.
    """
    whole = F.coalesce("kept", F.lit(False)) & F.col("start_t").isNotNull() & F.col("duration").isNotNull()
    marked = segments.select("run_id", "start_t", "duration", whole.alias("kept"))
    total = marked.groupBy("run_id").agg(F.count("*").alias("n_total"))
    kept = neighbours(marked.where("kept"), ["run_id"], ["start_t"], ["start_t"], width)
    gap = F.col("start_t") - F.col("prev.start_t")
    facts = kept.groupBy("run_id").agg(
        F.count("*").alias("n_kept"), F.min("start_t").alias("first_start"), F.max(F.col("start_t") + F.col("duration")).alias("last_end"),
        F.sum("duration").alias("covered_seconds"), F.bool_and(F.abs(gap - step) <= tolerance).alias("contiguous"),
    )
    out = total.join(facts, "run_id", "left").withColumns({"n_kept": F.coalesce("n_kept", F.lit(0).cast("long")), "contiguous": F.coalesce("contiguous", F.lit(True))})
    filled = F.abs(F.col("covered_seconds") - (F.col("last_end") - F.col("first_start"))) <= tolerance
    notes = F.array(
        F.when(F.col("first_start") - offset < 0, "before_start"),
        F.when((F.col("n_total") > F.col("n_kept")) & F.col("contiguous") & filled, "tiled"),
    )
    return out.withColumn("notes", F.array_join(notes, ","))


def frame_range(panel: DataFrame) -> DataFrame:
    """Least, greatest and mean finite value of each row of a run; 0 where none is finite."""
    v = finite("value")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return panel.groupBy("run_id", "row_idx").agg(
        zero(F.min(v)).alias("least"), zero(F.max(v)).alias("greatest"), zero(F.avg(v)).alias("mean"), F.count(v).alias("n_finite")
    )


def sampling_period(rows: DataFrame, width: float | None = None) -> DataFrame:
    """Median step between consecutive samples of each run."""
    gaps = neighbours(rows, ["run_id"], ["t"], ["t"], width).withColumn(
        "gap", F.col("t") - F.col("prev.t")
    )
    return exact_quantiles(gaps, ["run_id"], "gap", {"period": 0.5})


def step_change(series: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """Mean absolute and largest consecutive change over finite samples."""
    clean = series.where(F.col("value").isNotNull())
    d = F.abs(F.col("value") - F.col("prev.value"))
    return neighbours(clean, keys, ["t"], ["value"], width).groupBy(*keys).agg(
        F.avg(d).alias("mean_abs_change"), F.max(d).alias("max_step")
    )


def integral(series: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """Trapezoid integral over finite samples on their own time axis."""
    clean = series.where(F.col("value").isNotNull())
    area = (F.col("value") + F.col("prev.value")) / 2 * (F.col("t") - F.col("prev.t"))
    return neighbours(clean, keys, ["t"], ["value", "t"], width).groupBy(*keys).agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias("integral"), F.count("value").alias("samples")
    )


def display_scale(panel: DataFrame) -> DataFrame:
    """Percentiles, negative share and symmetric extent used to scale a run for display."""
    v = finite("value")
    base = panel.select("run_id", v.alias("value"))
    q = exact_quantiles(base, ["run_id"], "value", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    share = base.groupBy("run_id").agg(
        F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("negative_fraction")
    )
    return q.join(share, "run_id").withColumn(
        "extent", F.greatest(F.abs(F.col("p01")), F.abs(F.col("p99")))
    )


def region_contrast(
    a: DataFrame, b: DataFrame, unit_map: DataFrame, min_units: int = 20, top: int | None = None
) -> DataFrame:
    """Difference of two runs' time means by region, with a cancellation ratio.

    ``a`` and ``b`` are panels of one run each. The ratio |mean| / mean |.| is near zero
    where opposite unit effects cancel inside a region.
    """
    mean = lambda p, n: p.groupBy("unit_id").agg(F.avg(finite("value")).alias(n))
    delta = mean(a, "_a").join(mean(b, "_b"), "unit_id").withColumn("d", F.col("_a") - F.col("_b"))
    mapped = delta.join(unit_map.where("region_id IS NOT NULL").select("unit_id", "region_id"), "unit_id")
    out = (
        mapped.groupBy("region_id")
        .agg(
            F.count("d").alias("n_units"),
            F.avg("d").alias("mean_delta"),
            F.avg(F.abs("d")).alias("mean_abs_delta"),
        )
        .where(F.col("n_units") >= min_units)
        .withColumn("cancellation", safe_div(F.abs("mean_delta"), F.col("mean_abs_delta")))
    )
    if top is None:
        return out
    return out.orderBy(F.col("mean_abs_delta").desc(), "region_id").limit(top)
