"""Comparison of many candidates with a reference: gate, alignment by either method, report.

The gate reads run manifests only (one row a run). A pair that fails it is refused, with every
field that is to blame, before a panel is scanned. Alignment gives each reference row the two
candidate rows around it and the weight of the later one; an exact match is both rows with weight
0, so one difference join serves both methods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

from tidemark.functions.scalar import finite
from tidemark.operators import compare as C
from tidemark.operators.panel import region_means
from tidemark.operators.timejoin import asof
from tidemark.session import durable

PAIR = C.PAIR

# What two runs must share to be compared, and what must differ.
SAME = (
    "synthetic_status", "model_fingerprint", "preprocessing_config", "compatibility_patches", "surface_space", "vertex_count",
    "hemisphere_order", "hemisphere_ranges", "prediction_semantics", "prediction_units", "prediction_normalization",
    "includes_subcortex", "medial_wall_handling", "tr_seconds", "output_is_stimulus_aligned", "hemodynamic_offset_seconds",
    "hemodynamic_offset_applied_to_raw", "analytics_schema", "analytics_version", "analytics_aggregation", "atlas_name",
    "atlas_version", "atlas_surface", "ordered_regions", "unit_regions", "excluded_units", "network_names", "network_mapping",
)
OTHER = ("run_id", "stimulus_sha256")

EXACT, LINEAR = "exact_observed_intersection", "linear_candidate_to_reference"


def _comparable(c: Column, kind: DataType) -> Column:
    """The value in a form that has an equality: a map as its sorted entries."""
    if isinstance(kind, MapType):
        return F.array_sort(F.map_entries(c))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, MapType):
        return F.transform(c, lambda x: F.array_sort(F.map_entries(x)))
    return c


def comparability_report(manifests: DataFrame, pairs: DataFrame, same: tuple[str, ...] = SAME, other: tuple[str, ...] = OTHER) -> DataFrame:
    """(ref_run, cand_run, comparable, checks, issues) of every pair.

    A field of ``same`` passes when both runs have it equal, two nulls included; one of ``other``
    passes when they differ, so that two unknown stimuli are not taken for different ones. Fields
    that ``manifests`` (run_id, ...) lacks are not checked. ``checks`` maps a field to its result,
    ``issues`` lists the failed ones in declared order with a message.
    """
    kinds = {f.name: f.dataType for f in manifests.schema.fields}
    fields = [f for f in (*other, *same) if f in kinds]
    state = F.struct(*[_comparable(F.col(f), kinds[f]).alias(f) for f in fields])
    ref = manifests.select(F.col("run_id").alias("ref_run"), state.alias("r"))
    cand = manifests.select(F.col("run_id").alias("cand_run"), state.alias("c"))
    both = pairs.select(*PAIR).join(ref, "ref_run", "left").join(cand, "cand_run", "left")

    def passed(f: str) -> Column:
        equal = F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}"))
        return F.col("r").isNotNull() & F.col("c").isNotNull() & (equal if f in same else ~equal)

    def message(f: str) -> str:
        return f"reference and candidate differ in {f}" if f in same else f"reference and candidate must differ in {f}"

    checks = F.map_from_entries(F.array(*[F.struct(F.lit(f), passed(f)) for f in fields]))
    issues = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.lit(message(f)).alias("message"), passed(f).alias("ok")) for f in fields]), lambda x: ~x["ok"]
    )
    issues = F.transform(issues, lambda x: F.struct(x["field"].alias("field"), x["message"].alias("message")))
    out = both.select(*PAIR, checks.alias("checks"), issues.alias("issues"))
    return out.select(*PAIR, (F.size("issues") == 0).alias("comparable"), "checks", "issues")


class NotComparable(ValueError):
    """Runs that must not be compared; the message names the pairs and their fields."""


def require_comparable(report: DataFrame, shown: int = 20) -> None:
    """Refuse before any panel is read: one small job over the manifests."""
    refused = report.where(~F.col("comparable"))
    first = refused.orderBy(*PAIR).limit(shown + 1).collect()
    if first:
        lines = [f"{r.ref_run} and {r.cand_run}: {', '.join(i.field for i in r.issues)}" for r in first[:shown]]
        raise NotComparable("runs are not comparable: " + "; ".join(lines) + ("; ..." if len(first) > shown else ""))


def align_linear(rows: DataFrame, pairs: DataFrame, tolerance: float, max_gap: float, width: float | None = None) -> DataFrame:
    """Every reference row inside the candidate's time range, with the candidate rows around it.

    ``rows`` is ``run_id, row_idx, t``. Returns ``ref_row, t, left_row, right_row, weight, observed,
    problem``. A candidate row within ``tolerance`` is observed (both rows, weight 0); otherwise the
    row is interpolated with ``weight`` on the later row. Nothing is extrapolated: reference rows
    outside the range are left out. ``problem`` is ``ambiguous`` (two candidate rows within the
    tolerance) or ``gap`` (a bracket wider than ``max_gap``), else null.
    """
    ref = rows.select(F.col("run_id").alias("ref_run"), F.col("row_idx").alias("ref_row"), F.col("t").cast("double").alias("t")).join(pairs, "ref_run")
    cand = rows.select(F.col("run_id").alias("cand_run"), F.col("row_idx").alias("row"), F.col("t").cast("double").alias("at")).join(pairs, "cand_run")
    both = asof(ref, cand, PAIR, "t", "at", ["row", "at"], width)
    before, after = F.col("t") - F.col("lo.at"), F.col("hi.at") - F.col("t")
    near_left, near_right = F.coalesce(before <= tolerance, F.lit(False)), F.coalesce(after <= tolerance, F.lit(False))
    same = F.col("lo.row").eqNullSafe(F.col("hi.row"))
    observed = near_left | near_right
    gap = F.col("hi.at") - F.col("lo.at")
    inside = observed | (F.col("lo").isNotNull() & F.col("hi").isNotNull())
    problem = F.when(near_left & near_right & ~same, "ambiguous").when(~observed & (gap > max_gap), "gap")
    return both.where(inside).select(
        *PAIR, "ref_row", "t",
        F.when(near_left | ~observed, F.col("lo.row")).otherwise(F.col("hi.row")).alias("left_row"),
        F.when(near_left, F.col("lo.row")).otherwise(F.col("hi.row")).alias("right_row"),
        F.when(observed, 0.0).otherwise(before / gap).alias("weight"), observed.alias("observed"), problem.alias("problem"),
    )


def align(rows: DataFrame, pairs: DataFrame, method: str = EXACT, tolerance: float = 1e-6, max_gap: float = 10.0, width: float | None = None) -> DataFrame:
    """Aligned rows by either method, in the columns of :func:`align_linear`."""
    if method == LINEAR:
        return align_linear(rows, pairs, tolerance, max_gap, width)
    if method != EXACT:
        raise ValueError(f"unsupported alignment method {method}")
    exact = C.align_rows(rows, pairs, tolerance)
    return exact.select(
        *PAIR, "ref_row", "t", F.col("cand_row").alias("left_row"), F.col("cand_row").alias("right_row"), F.lit(0.0).alias("weight"),
        F.lit(True).alias("observed"), F.when(F.col("ambiguous"), "ambiguous").alias("problem"),
    )


def strict(aligned: DataFrame) -> DataFrame:
    """Fail the job on the first row that is ambiguous or bridges too wide a gap."""
    text = F.concat(F.lit("timeline alignment has a problem: "), F.col("problem"))
    guard = F.when(F.col("problem").isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return aligned.where(guard)


def coverage(aligned: DataFrame, rows: DataFrame) -> DataFrame:
    """Aligned and interpolated rows of each pair and the fractions of both sides they use.

    A candidate row counts as used once, however many reference rows it brackets.
    """
    sizes = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    ref = sizes.select(F.col("run_id").alias("ref_run"), F.col("n").alias("reference_samples"))
    cand = sizes.select(F.col("run_id").alias("cand_run"), F.col("n").alias("candidate_samples"))
    sides = F.explode(F.array_distinct(F.array("left_row", "right_row")))
    used = aligned.select(*PAIR, sides.alias("row")).distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_used"))
    facts = aligned.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("aligned_samples"), F.count(F.when(~F.col("observed"), 1)).alias("interpolated_samples"),
        F.min("t").alias("first_time"), F.max("t").alias("last_time"),
    )
    out = facts.join(used, PAIR).join(ref, "ref_run").join(cand, "cand_run")
    return out.select(
        *PAIR, "aligned_samples", "interpolated_samples", "reference_samples", "candidate_samples", "first_time", "last_time",
        (F.col("aligned_samples") / F.col("reference_samples")).alias("reference_fraction"),
        (F.col("_used") / F.col("candidate_samples")).alias("candidate_fraction"),
    )


def difference(aligned: DataFrame, cells: DataFrame, key: str = "unit_id") -> DataFrame:
    """Candidate minus reference for every aligned row and unit (or region), the candidate interpolated.

    A cell that is missing or not finite on either side, or at either end of its bracket, has a
    NULL delta. Observed rows need one candidate row, so only interpolated ones join a second.
    """
    v = finite("value")
    ref = cells.select(F.col("run_id").alias("ref_run"), F.col("row_idx").alias("ref_row"), key, v.alias("ref_value"))
    side = lambda name: cells.select(F.col("run_id").alias("cand_run"), F.col("row_idx").alias(f"{name}_row"), key, v.alias(f"{name}_value"))
    with_left = aligned.join(ref, ["ref_run", "ref_row"]).join(side("left"), ["cand_run", "left_row", key])
    columns = [*PAIR, "ref_row", "left_row", "right_row", "weight", "observed", "t", key, "ref_value"]
    seen = with_left.where("observed").select(*columns, F.col("left_value").alias("cand_value"))
    w = F.col("weight")
    between = with_left.where("NOT observed").join(side("right"), ["cand_run", "right_row", key])
    between = between.select(*columns, (F.col("left_value") * (1 - w) + F.col("right_value") * w).alias("cand_value"))
    out = seen.unionByName(between).withColumn("delta", F.col("cand_value") - F.col("ref_value"))
    return out.withColumn("cand_row", F.when(F.col("observed"), F.col("left_row")))


@dataclass(frozen=True)
class Comparison:
    """Tables of one comparison, each with a row per pair and its own key."""

    report: DataFrame
    alignment: DataFrame
    rows: DataFrame
    regions: DataFrame
    networks: DataFrame
    events: DataFrame
    windows: DataFrame


def compare_variants(
    panel: DataFrame,
    unit_map: DataFrame,
    pairs: DataFrame,
    manifests: DataFrame | None = None,
    method: str = EXACT,
    tolerance: float = 1e-6,
    max_gap: float = 10.0,
    radius: int = 1,
    max_events: int = 20,
    top_regions: int = 5,
    refuse: bool = True,
    width: float | None = None,
) -> Comparison:
    """Compare every candidate of ``pairs`` with its reference.

    With ``manifests`` the gate comes first: ``refuse`` raises for the first pairs that fail it,
    otherwise they are left out and only the report names them. Problem rows of the alignment
    fail the job under ``refuse`` and are left out otherwise. The panel is read once into aligned
    differences, which are written, and every table derives from them.
    """
    if manifests is not None:
        report = durable(comparability_report(manifests, pairs))
        if refuse:
            require_comparable(report)
        pairs = report.where("comparable").select(*PAIR)
    else:
        report = pairs.select(*PAIR, F.lit(True).alias("comparable"))
    rows = panel.select("run_id", "row_idx", "t").distinct()
    aligned = align(rows, pairs, method, tolerance, max_gap, width)
    aligned = durable(strict(aligned) if refuse else aligned.where("problem IS NULL")).drop("problem")
    cells = panel.join(unit_map.where(~F.col("excluded")).select("unit_id"), "unit_id", "left_semi")
    differences = durable(C.row_differences(difference(aligned, cells)))
    regional = durable(difference(aligned, region_means(panel, unit_map, "region_id"), "region_id"))
    networks = difference(aligned, region_means(panel, unit_map, "network_id"), "network_id")
    events = durable(C.rank_divergence(differences, radius, max_events, width))
    return Comparison(
        report=report,
        alignment=coverage(aligned, rows),
        rows=differences,
        regions=C.difference_summary(regional, "region_id"),
        networks=C.difference_summary(networks, "network_id"),
        events=C.top_regions_of(events, regional, top_regions),
        windows=C.rank_windows(events, differences, radius, width),
    )


def summary(found: Comparison) -> DataFrame:
    """One row for each pair: gate, alignment, number and strongest of events, windows and regions.

    A refused pair keeps its row, with its fields and without figures.
    """
    report = found.report
    fields = F.array_join(F.transform("issues", lambda x: x["field"]), ",") if "issues" in report.columns else F.lit("")
    best = Window.partitionBy(*PAIR)
    events = found.events.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("events"), F.max("rms").alias("peak_rms"), F.min_by("t", "event_rank").alias("peak_time"),
        F.min_by("top_region_ids", "event_rank").alias("peak_regions"),
    )
    windows = found.windows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("windows"), F.max("mean_rms").alias("window_rms"))
    regions = found.regions.withColumn("_top", F.max(F.struct("mean_absolute_delta", -F.col("region_id"))).over(best))
    regions = regions.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("regions"), (-F.first("_top.col2")).alias("strongest_region"))
    out = report.select(*PAIR, "comparable", fields.alias("refused_fields"))
    for table in (found.alignment, events, windows, regions):
        out = out.join(table, PAIR, "left")
    return out
