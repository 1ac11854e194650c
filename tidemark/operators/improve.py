"""Where a variant falls short and what the better ones do there: gaps, weak intervals,
evidence, rule-based recommendations, validation and ranking.

Everything is a join or a grouped aggregate over score, interval and feature tables; the
rule table is a fixed literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.functions.text import forbidden_claims
from tidemark.operators.panel import ordered_list, sampling_period
from tidemark.operators.ranks import top_k
from tidemark.operators.sequence import in_order, islands
from tidemark.operators.timejoin import overlap_join, stab_join
from tidemark.session import durable

# Shares of an even split that make an interval weak or strong, merge gap,
# fewest samples for content evidence, smallest relative difference worth reporting.
WEAK_SHARE, STRONG_SHARE, MERGE_GAP = 0.25, 2.0, 1.5
MIN_SAMPLES, MIN_RELATIVE = 2, 0.15

# Feature, intervention, template, cost, operation, modality. Every rule
# answers a reference value above the source's.
RULES = (
    ("motion", "pace_edit", "Increase visual movement during {interval}", "medium", "adjust_feature", "visual"),
    ("motion_structural", "visual_edit", "Introduce subject movement during {interval}", "medium", "adjust_feature", "visual"),
    ("shot_change", "shot_edit", "Increase cutting rate during {interval}", "medium", "adjust_pace", "visual"),
    ("speech_present", "speech_edit", "Add spoken narration during {interval}", "medium", "insert_speech", "speech"),
    ("speech_activity", "speech_edit", "Extend speech across {interval}", "medium", "insert_speech", "speech"),
    ("audio_energy", "audio_edit", "Raise audio energy during {interval}", "low", "adjust_feature", "audio"),
    ("text_present", "text_edit", "Add an on-screen text overlay during {interval}", "low", "adjust_feature", "text"),
    ("cta_present", "cta_edit", "Bring the call to action into {interval}", "low", "move_event", "text"),
    ("object_count", "product_visibility_edit", "Increase on-screen subject visibility during {interval}", "medium", "adjust_feature", "visual"),
    ("brightness", "visual_edit", "Raise scene brightness during {interval}", "low", "adjust_feature", "visual"),
    ("saturation", "visual_edit", "Increase colour saturation during {interval}", "low", "adjust_feature", "visual"),
    ("luminance_shift", "shot_edit", "Add a lighting or shot transition during {interval}", "medium", "adjust_pace", "visual"),
)
# Ranking cost per edit cost; information value of a bundle.
COST_WEIGHT = {"low": 1.0, "medium": 1.6, "high": 2.6}
BUNDLE_VALUE = 0.6


def select_references(
    ranking: DataFrame, source: str | int, strategy: str = "best_score",
    manual: Sequence[str | int] = (), baseline: str | int | None = None, front: DataFrame | None = None,
) -> DataFrame:
    """Runs to learn from: manual, baseline, pareto_front, or all that score above the source."""
    scored = ranking.where(F.col("total_score").isNotNull())
    others = scored.where(F.col("run_id") != F.lit(source))
    if strategy == "manual":
        return others.where(F.col("run_id").isin(list(manual))).select("run_id", "total_score")
    if strategy == "baseline":
        return others.where(F.col("run_id") == F.lit(baseline)).select("run_id", "total_score")
    if strategy == "pareto_front":
        if front is None:
            raise ValueError("the Pareto strategy needs a front")
        return others.join(front.select("run_id"), "run_id", "left_semi").select("run_id", "total_score")
    if strategy != "best_score":
        raise ValueError(f"unknown reference strategy {strategy}")
    mine = scored.where(F.col("run_id") == F.lit(source)).select(F.lit(0).alias("_k"), F.col("total_score").alias("_own"))
    return (
        others.withColumn("_k", F.lit(0)).join(mine, "_k").where(F.col("total_score") > F.col("_own"))
        .select("run_id", "total_score")
    )


def objective_gaps(source: DataFrame, reference: DataFrame, spec: DataFrame) -> DataFrame:
    """Gap per objective in the objective's own terms, with the formula used.

    ``source`` and ``reference`` are ``objective_id, raw_value``; ``spec`` has ``direction,
    target_value``.
    """
    s = source.select("objective_id", F.col("raw_value").alias("source_value"))
    ref = reference.select("objective_id", F.col("raw_value").alias("_ref"))
    d = spec.select("objective_id", "direction", "target_value").join(s, "objective_id", "left").join(ref, "objective_id", "left")
    is_target = F.col("direction") == "target"
    reference_value = F.when(is_target, F.col("target_value")).otherwise(F.col("_ref"))
    known = F.col("source_value").isNotNull() & reference_value.isNotNull()
    gap = (
        F.when(is_target, F.abs(F.col("source_value") - reference_value))
        .when(F.col("direction") == "maximize", reference_value - F.col("source_value"))
        .otherwise(F.col("source_value") - reference_value)
    )
    formula = (
        F.when(~known, "unavailable").when(is_target, "abs(source - target)")
        .when(F.col("direction") == "maximize", "reference - source").otherwise("source - reference")
    )
    out = d.withColumn("reference_value", reference_value).withColumn("gap", F.when(known, gap))
    return out.withColumn("relative_gap", ratio("gap", F.abs("reference_value"))).withColumn("formula", formula).drop(
        "_ref", "target_value"
    )


def contribution_shares(parts: DataFrame, width: float | None = None) -> DataFrame:
    """Share of the summed magnitude per sample, with the even share of the run."""
    keys = ["run_id", "objective_id"]
    totals = in_order(parts, keys, ["row_idx"], width).groupBy(*keys).agg(F.sum(F.abs("contribution")).alias("_total"), F.count(F.lit(1)).alias("_n"))
    return parts.join(totals, keys).where("_total > 0").select(
        *keys, "t", "contribution", (F.abs("contribution") / F.col("_total")).alias("share"), (F.lit(1.0) / F.col("_n")).alias("even")
    )


def detect_intervals(
    parts: DataFrame, reference_run: str | int | None = None, merge_gap: float = MERGE_GAP,
    bucket: float = 10.0, width: float | None = None,
) -> DataFrame:
    """Weak and strong intervals of every run and objective at once.

    Samples below a quarter (above twice) of an even share, merged across small gaps; each
    interval ends one sampling period after its last sample.
    """
    shares = contribution_shares(parts, width)
    kind = F.when(F.col("share") < F.col("even") * WEAK_SHARE, "weak").when(
        F.col("share") > F.col("even") * STRONG_SHARE, "strong"
    )
    marked = shares.withColumn("kind", kind).where(F.col("kind").isNotNull())
    keys = ["run_id", "objective_id", "kind"]
    grouped = islands(marked, keys, ["t"], lambda p: F.col("t") - p["t"] > merge_gap, ["t"], width)
    runs = parts.select(F.struct("run_id", "objective_id").alias("run_id"), "t")
    period = sampling_period(runs, width).select("run_id.*", "period")
    found = grouped.groupBy(*keys, "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("_last"), F.count(F.lit(1)).alias("samples"),
        F.sum("share").alias("contribution_share"), F.sum("contribution").alias("contribution"),
    )
    out = found.join(period, ["run_id", "objective_id"], "left").withColumn(
        "end_t", F.col("_last") + F.coalesce("period", F.lit(1.0))
    )
    numbered = out.withColumn("interval_no", F.col("island") - 1).drop("island", "_last", "period")
    if reference_run is None:
        return numbered.withColumn("reference_share", F.lit(None).cast("double"))
    ref = shares.where(F.col("run_id") == F.lit(reference_run)).select("objective_id", F.col("t").alias("rt"), F.col("share").alias("rs"))
    spans = numbered.select(*keys, "interval_no", "start_t", "end_t")
    over = stab_join(ref, spans, ["objective_id"], "rt", ("start_t", "end_t"), bucket)
    summed = over.groupBy(*keys, "interval_no").agg(F.sum("rs").alias("reference_share"))
    return numbered.join(summed, [*keys, "interval_no"], "left")


def interval_feature_means(
    intervals: DataFrame, features: DataFrame, bucket: float
) -> tuple[DataFrame, DataFrame]:
    """Mean of every feature of every run inside each interval, and the samples it rests on.

    ``intervals`` is ``interval_id, start_t, end_t``; ``features`` is ``run_id, t, feature, value``.
    """
    inside = stab_join(
        features.select("run_id", F.col("t").alias("ft"), "feature", "value"),
        intervals.select("interval_id", "start_t", "end_t"), [], "ft", ("start_t", "end_t"), bucket,
    )
    means = inside.groupBy("interval_id", "run_id", "feature").agg(F.avg("value").alias("mean_value"))
    counts = inside.groupBy("interval_id", "run_id").agg(F.countDistinct("ft").alias("samples"))
    return means, counts


def feature_evidence(
    means: DataFrame, counts: DataFrame, source: str | int, references: DataFrame
) -> DataFrame:
    """Features that differ enough between the source and its references in an interval."""
    usable = means.join(counts.where(F.col("samples") >= MIN_SAMPLES), ["interval_id", "run_id"])
    src = usable.where(F.col("run_id") == F.lit(source)).select(
        "interval_id", "feature", F.col("mean_value").alias("source_value"), F.col("samples").alias("sample_count")
    )
    ref = usable.join(references.select("run_id"), "run_id", "left_semi").select("interval_id", "run_id", "feature", "mean_value")
    paired = src.join(ref, ["interval_id", "feature"]).withColumn("d", F.col("mean_value") - F.col("source_value"))
    facts = paired.groupBy("interval_id", "feature", "source_value", "sample_count").agg(
        F.avg("d").alias("delta"), F.count(F.lit(1)).alias("reference_count"), F.max(F.abs("d")).alias("_big"),
        F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("_up"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("_down"),
    )
    scale = F.greatest(F.abs("source_value"), F.col("_big"), F.lit(1e-9))
    agreeing = F.when(F.col("delta") > 0, F.col("_up")).when(F.col("delta") < 0, F.col("_down")).otherwise(
        F.col("reference_count") - F.col("_up") - F.col("_down")
    )
    return facts.where(F.abs("delta") / scale >= MIN_RELATIVE).select(
        "interval_id", "feature", "source_value", (F.col("source_value") + F.col("delta")).alias("reference_value"), "delta",
        "reference_count", F.when(F.col("reference_count") >= 2, agreeing / F.col("reference_count")).alias("consistency"), "sample_count",
    )


def event_presence(
    intervals: DataFrame, events: DataFrame, source: str | int, references: DataFrame, bucket: float
) -> DataFrame:
    """Event kinds that references have over an interval and the source does not.

    ``events`` is ``run_id, event_type, start_t, end_t``.
    """
    spans = intervals.where(F.col("samples") >= MIN_SAMPLES).select(
        "interval_id", F.col("start_t").alias("a"), F.col("end_t").alias("b")
    )
    hits = overlap_join(spans, events, [], ("a", "b"), ("start_t", "end_t"), bucket).select(
        "interval_id", "run_id", "event_type"
    ).distinct()
    own = hits.where(F.col("run_id") == F.lit(source)).select("interval_id", "event_type")
    others = hits.join(references.select("run_id"), "run_id", "left_semi").join(own, ["interval_id", "event_type"], "left_anti")
    total = references.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = others.groupBy("interval_id", "event_type").agg(F.count(F.lit(1)).alias("reference_hits"))
    return out.withColumn("reference_count", total).withColumn(
        "consistency", F.when(F.col("reference_count") >= 2, F.col("reference_hits") / F.col("reference_count"))
    )


def regional_evidence(shares: DataFrame, source: str | int, references: DataFrame, top: int = 3) -> DataFrame:
    """Regions whose share of the objective's magnitude differs most from each reference."""
    own = shares.where(F.col("run_id") == F.lit(source)).select(
        "region_id", F.col("share").alias("_own"), F.col("mean_value").alias("source_value")
    )
    ref = shares.join(references.select("run_id"), "run_id", "left_semi").select(
        F.col("run_id").alias("reference_run"), "region_id", F.col("share").alias("_ref"), F.col("mean_value").alias("reference_value")
    )
    both = own.join(ref, "region_id").withColumn("share_delta", F.col("_ref") - F.col("_own")).drop("_own", "_ref")
    return top_k(both, ["reference_run"], [F.abs("share_delta").desc(), F.col("region_id")], top, "position")


def evidence_rows(gaps: DataFrame, intervals: DataFrame) -> DataFrame:
    """Citable rows for objective gaps and for the contribution of each interval."""
    gap_rows = gaps.where("gap IS NOT NULL").select(
        F.concat(F.col("objective_id"), F.lit("-GAP")).alias("evidence_id"), F.lit("objective_gap").alias("kind"), "objective_id",
        "source_value", "reference_value", F.col("gap").alias("delta"), F.lit(None).cast("bigint").alias("sample_count"),
    )
    share_rows = intervals.select(
        F.concat("interval_id", F.lit("-CONTRIB")).alias("evidence_id"), F.lit("contribution_share").alias("kind"), "objective_id",
        F.col("contribution_share").alias("source_value"), F.col("reference_share").alias("reference_value"),
        F.lit(None).cast("double").alias("delta"), F.col("samples").cast("bigint").alias("sample_count"),
    )
    return gap_rows.unionByName(share_rows)


def confidence(
    consistency: Column, source_value: Column, reference_value: Column, delta: Column, gap: Column,
    relative_gap: Column, gap_source: Column, gap_reference: Column, samples: Column,
) -> Column:
    """How well supported a test is: agreement, size of the difference, gap and volume.

    0.40 / 0.25 / 0.25 / 0.10, halved under two samples. Undefined agreement counts 0.
    """
    def strength(d: Column, a: Column, b: Column) -> Column:
        scale = F.greatest(F.abs(a), F.abs(F.coalesce(b, F.lit(0.0))), F.lit(1e-9))
        return F.least(F.lit(1.0), F.abs(d) / scale)

    own = strength(delta, source_value, reference_value)
    of_gap = strength(gap, gap_source, gap_reference)
    measured = F.array_compact(F.array(F.when(delta.isNotNull(), own), F.when(gap.isNotNull(), of_gap)))
    mean = F.when(
        F.size(measured) > 0, F.aggregate(measured, F.lit(0.0), lambda a, x: a + x) / F.size(measured)
    ).otherwise(F.lit(0.0))
    gap_part = F.when(
        gap > 0,
        F.when(F.coalesce(relative_gap, F.lit(0.0)) != 0, F.least(F.lit(1.0), F.abs(relative_gap))).otherwise(F.lit(0.5)),
    ).otherwise(F.lit(0.0))
    volume = (F.lit(2.0) + F.when(gap.isNotNull(), 1.0).otherwise(0.0)) / 4.0
    value = 0.40 * F.coalesce(consistency, F.lit(0.0)) + 0.25 * mean + 0.25 * gap_part + 0.10 * volume
    halved = F.when(samples < 2, value * 0.5).otherwise(value)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), halved)), 4)


def _rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RULES), "feature string, intervention string, template string, cost string, operation string, modality string"
    )


def recommend(
    evidence: DataFrame, presence: DataFrame, intervals: DataFrame, gaps: DataFrame
) -> DataFrame:
    """One atomic recommendation per qualifying feature or missing event kind."""
    span = intervals.select("interval_id", "objective_id", "start_t", "end_t", "samples")
    gap = gaps.select("objective_id", "direction", "gap", "relative_gap", F.col("source_value").alias("_gs"), F.col("reference_value").alias("_gr"))
    where = F.format_string("%.2f-%.2fs", "start_t", "end_t")
    none = F.lit(None).cast("double")
    common = ["interval_id", "objective_id", "start_t", "end_t", "samples", "direction"]

    def score(src: Column, ref: Column, delta: Column) -> Column:
        return confidence(
            F.col("consistency"), src, ref, delta, F.col("gap"), F.col("relative_gap"), F.col("_gs"), F.col("_gr"), F.col("samples")
        )

    by_rule = (
        evidence.where("delta > 0").join(_rule_table(evidence.sparkSession), "feature").join(span, "interval_id").join(gap, "objective_id", "left")
    )
    atomic = by_rule.select(
        F.concat_ws("-", "interval_id", "feature").alias("recommendation_id"), *common, "intervention", "modality", "cost", "operation",
        "feature", F.replace("template", F.lit("{interval}"), where).alias("title"),
        (F.col("source_value") + F.col("delta")).alias("target_value"),
        F.array(F.concat_ws("-", "interval_id", "feature"), F.concat("interval_id", F.lit("-CONTRIB")), F.concat("objective_id", F.lit("-GAP"))).alias("evidence_ids"),
        score(F.col("source_value"), F.col("reference_value"), F.col("delta")).alias("confidence"), F.lit(False).alias("is_bundle"),
    )
    missing = presence.join(span, "interval_id").join(gap, "objective_id", "left")
    kind = F.col("event_type")
    placed = missing.select(
        F.concat_ws("-", "interval_id", F.lit("event"), kind).alias("recommendation_id"), *common,
        F.when(kind == "cta", "cta_edit").when(kind == "speech_segment", "speech_edit").otherwise("scene_structure_edit").alias("intervention"),
        F.when(kind == "speech_segment", "speech").otherwise("text").alias("modality"), F.lit("medium").alias("cost"), F.lit("move_event").alias("operation"),
        F.concat(F.lit("event:"), kind).alias("feature"),
        F.concat(F.lit("Introduce a "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" into "), where).alias("title"), none.alias("target_value"),
        F.array(F.concat_ws("-", "interval_id", F.lit("event"), kind), F.concat("interval_id", F.lit("-CONTRIB")), F.concat("objective_id", F.lit("-GAP"))).alias("evidence_ids"),
        score(none, none, none).alias("confidence"), F.lit(False).alias("is_bundle"),
    )
    direction = F.when(F.col("direction") == "target", "test_for_target_proximity").when(
        F.col("direction") == "minimize", "test_for_decrease"
    ).otherwise("test_for_increase")
    return atomic.unionByName(placed).withColumn("expected_direction", direction).drop("direction")


def bundle(recommendations: DataFrame, size: int = 3) -> DataFrame:
    """First ``size`` atomic recommendations of each interval as one combined test."""
    first = top_k(recommendations.where(~F.col("is_bundle")), ["interval_id"], [F.col("feature").startswith("event:"), F.col("recommendation_id")], size, "_k")
    kinds = F.array_sort(F.collect_list("intervention"))
    return (
        first.groupBy("interval_id", "objective_id", "start_t", "end_t", "samples", "expected_direction")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.array_join(kinds, "+").alias("intervention"), F.min("confidence").alias("confidence"),
            F.concat(F.lit("Combined test: "), F.array_join(ordered_list("_k", "title"), ", ")).alias("title"),
            F.array_distinct(F.flatten(ordered_list("_k", "evidence_ids"))).alias("evidence_ids"),
        )
        .where("_n >= 2")
        .select(
            F.concat("interval_id", F.lit("-BUNDLE")).alias("recommendation_id"), "interval_id", "objective_id", "start_t", "end_t", "samples",
            "intervention", F.lit("mixed").alias("modality"), F.lit("high").alias("cost"), F.lit("bundle").alias("operation"), F.lit("bundle").alias("feature"),
            "title", F.lit(None).cast("double").alias("target_value"), "evidence_ids", "confidence", F.lit(True).alias("is_bundle"), "expected_direction",
        )
    )


def validation_reasons(
    recommendations: DataFrame,
    evidence_ids: DataFrame,
    frozen_modalities: Sequence[str] = (),
    preserve: Sequence[tuple[float, float]] = (),
    frozen_events: Sequence[str] = (),
    forbid_voiceover: bool = False,
) -> DataFrame:
    """Adds ``reasons``: every blocking problem of a recommendation, empty when acceptable.

    Cited evidence that does not exist is found by an anti join on the exploded ids.
    """
    cited = recommendations.select("recommendation_id", F.explode("evidence_ids").alias("evidence_id"))
    orphans = cited.join(evidence_ids.select("evidence_id").distinct(), "evidence_id", "left_anti").groupBy("recommendation_id").agg(
        F.sort_array(F.collect_list("evidence_id")).alias("_missing")
    )
    joined = recommendations.join(orphans, "recommendation_id", "left")
    overlap = [(F.col("start_t") < b) & (F.col("end_t") > a) for a, b in preserve]
    touches = F.lit(False)
    for hit in overlap:
        touches = touches | hit
    text_frozen = bool({"cta", "text_overlay"} & set(frozen_events))
    claims = forbidden_claims(F.col("title"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_missing").isNotNull(), F.concat(F.lit("unknown evidence: "), F.array_join("_missing", ","))),
            F.when(F.size("evidence_ids") == 0, "cites no evidence"),
            F.when(F.col("modality").isin(list(frozen_modalities)) if frozen_modalities else F.lit(False), F.concat(F.lit("frozen modality "), F.col("modality"))),
            F.when(F.lit(forbid_voiceover) & (F.col("intervention") == "speech_edit"), "new speech forbidden"),
            F.when(touches, "overlaps a preserved interval"),
            F.when(F.lit(text_frozen) & F.col("intervention").isin("text_edit", "cta_edit"), "frozen event type"),
            F.when(F.size(claims) > 0, F.concat(F.lit("unsupported claim: "), F.array_join(claims, ","))),
            F.when(F.col("end_t") <= F.col("start_t"), "empty interval"),
            F.when(F.col("operation").isNull(), "no edit instruction"),
        )
    )
    return joined.withColumn("reasons", reasons).drop("_missing")


def deduplicate(recommendations: DataFrame) -> DataFrame:
    """Same edit over the same rounded interval: the better supported one stays.

    Adds ``kept`` and ``duplicate_of``.
    """
    w = Window.partitionBy("intervention", F.round("start_t", 2), F.round("end_t", 2)).orderBy(
        F.col("confidence").desc(), F.col("recommendation_id")
    )
    return recommendations.withColumn("_k", F.row_number().over(w)).withColumn(
        "duplicate_of", F.when(F.col("_k") > 1, F.first("recommendation_id").over(w))
    ).withColumn("kept", F.col("_k") == 1).drop("_k")


def rank_recommendations(recommendations: DataFrame, n: int, diversify: bool = True) -> DataFrame:
    """Priority = confidence x information value / cost; one per intervention type first."""
    cost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COST_WEIGHT.items() for x in kv]), F.col("cost")), F.lit(1.6))
    value = F.when(F.col("is_bundle"), BUNDLE_VALUE).otherwise(1.0)
    scored = recommendations.withColumn("priority", F.round(F.col("confidence") * value / cost, 6))
    order = [F.col("priority").desc(), F.col("recommendation_id")]
    if diversify:
        # Only the best n of each type can appear; the type winners come first.
        per_type = top_k(scored, ["intervention"], order, n, "_type_rank")
        first = F.when(F.col("_type_rank") == 1, 0).otherwise(1)
        best = per_type.orderBy(first, *order).limit(n)
        w = Window.orderBy(first, *order)
        return best.withColumn("position", F.row_number().over(w)).drop("_type_rank")
    best = scored.orderBy(*order).limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def no_evidence_reason(
    intervals: DataFrame, counts: DataFrame, evidence: DataFrame, references: DataFrame
) -> DataFrame:
    """Why an interval produced no feature evidence: too short, uncovered, or alike."""
    total = references.agg(F.count(F.lit(1)).alias("n")).scalar()
    covered = counts.join(references.select("run_id"), "run_id", "left_semi").where(F.col("samples") >= MIN_SAMPLES).groupBy(
        "interval_id"
    ).agg(F.count(F.lit(1)).alias("_covered"))
    bare = intervals.join(evidence.select("interval_id").distinct(), "interval_id", "left_anti").join(covered, "interval_id", "left")
    have = F.coalesce(F.col("_covered"), F.lit(0))
    return bare.withColumn("_total", total).select(
        "interval_id",
        F.when(F.col("samples") < MIN_SAMPLES, "too few samples").when(have == 0, "no reference covers it")
        .when(have < F.col("_total"), "some references do not cover it").otherwise("no feature differed enough").alias("reason"),
    )


def optimise(
    source: str | int,
    intervals: DataFrame,
    gaps: DataFrame,
    features: DataFrame,
    events: DataFrame,
    references: DataFrame,
    bucket: float,
    n: int = 10,
    bundles: bool = True,
    **constraints: object,
) -> tuple[DataFrame, DataFrame]:
    """(all recommendations with their verdicts, the ranked short list)."""
    means, counts = interval_feature_means(intervals, features, bucket)
    # Small evidence tables, read by the rules, the orphan check and the ranking.
    found = durable(feature_evidence(means, counts, source, references))
    present = durable(event_presence(intervals, events, source, references, bucket))
    made = recommend(found, present, intervals, gaps)
    if bundles:
        made = made.unionByName(bundle(made))
    ids = (
        found.select(F.concat_ws("-", "interval_id", "feature").alias("evidence_id"))
        .unionByName(present.select(F.concat_ws("-", "interval_id", F.lit("event"), "event_type").alias("evidence_id")))
        .unionByName(evidence_rows(gaps, intervals).select("evidence_id"))
    )
    checked = durable(validation_reasons(made, ids, **constraints))
    accepted = deduplicate(checked.where(F.size("reasons") == 0))
    rejected = checked.where(F.size("reasons") > 0).withColumn("duplicate_of", F.lit(None).cast("string")).withColumn("kept", F.lit(False))
    verdicts = accepted.unionByName(rejected)
    return verdicts, rank_recommendations(accepted.where("kept").drop("kept", "duplicate_of"), n)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Last review of each recommendation by sequence."""
    return reviews.groupBy("recommendation_id").agg(
        F.max_by(F.struct("state", "modified", "seq"), "seq").alias("r")
    ).select("recommendation_id", "r.*")


def approved_spec(recommendations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Interventions that go into a new candidate: approved, or modified with its replacement."""
    accepted = latest_reviews(reviews).where(F.col("state").isin("approved", "modified"))
    return recommendations.join(accepted, "recommendation_id").withColumn(
        "intervention", F.when(F.col("state") == "modified", F.coalesce("modified", "intervention")).otherwise(F.col("intervention"))
    ).drop("modified", "seq")


def outcomes(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Improved, worsened, unchanged or inconclusive, by direction.

    ``pairs`` has ``direction, target_value, parent_value, candidate_value``.
    """
    delta = F.col("candidate_value") - F.col("parent_value")
    preference = (
        F.when(F.col("direction") == "minimize", -delta)
        .when(
            F.col("direction") == "target",
            F.abs(F.col("parent_value") - F.col("target_value")) - F.abs(F.col("candidate_value") - F.col("target_value")),
        )
        .otherwise(delta)
    )
    label = (
        F.when(preference.isNull(), "inconclusive").when(preference > tolerance, "improved")
        .when(preference < -tolerance, "worsened").otherwise("unchanged")
    )
    return pairs.withColumn("raw_delta", delta).withColumn("outcome", label)
