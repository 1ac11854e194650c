"""Experiment scoring: windows, targets, metrics, normalisation, composites, ranking.

Objectives are declared as dataclasses (few, driver side) and become columns or a literal
table; variants are runs and may be many. A value that cannot be measured stays NULL with a
reason; it never turns into zero and its row is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.registry import METRICS
from tidemark.functions.scalar import ratio
from tidemark.operators.ranks import exact_quantiles, ranked, top_k
from tidemark.operators.sequence import in_order, neighbours, ordinal
from tidemark.operators.timejoin import stab_join
from tidemark.session import durable

CLOSE_MARGIN = 0.01
WEIGHT_DRIFT = 0.15


@dataclass(frozen=True)
class Scope:
    """Temporal scope: full, absolute, normalized, event or event_relative."""

    kind: str = "full"
    start: float | None = None
    end: float | None = None
    event_type: str | None = None
    selection: str = "first"
    skip_empty: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("full", "absolute", "normalized", "event", "event_relative"):
            raise ValueError(f"unknown scope {self.kind}")
        if self.kind.startswith("event") and not self.event_type:
            raise ValueError("an event scope needs an event type")
        if self.selection not in ("first", "last", "longest"):
            raise ValueError(f"unknown selection {self.selection}")
        if self.kind in ("absolute", "normalized", "event_relative") and (
            self.start is None or self.end is None or self.end <= self.start
        ):
            raise ValueError("scope bounds must be given and increasing")


@dataclass(frozen=True)
class Objective:
    objective_id: str
    metric: str
    units: tuple[str, ...] | None = None  # None = every unit
    scope: Scope = Scope()
    direction: str = "maximize"
    normalization: str = "min_max"
    weight: float = 1.0
    target_value: float | None = None
    target_tolerance: float | None = None

    def __post_init__(self) -> None:
        METRICS.require([self.metric])
        if self.direction not in ("maximize", "minimize", "target"):
            raise ValueError(f"unknown direction {self.direction}")
        if self.normalization not in ("none", "min_max", "z_score", "baseline", "robust", "target_distance"):
            raise ValueError(f"unknown normalization {self.normalization}")
        if self.weight < 0:
            raise ValueError("weights are non-negative")
        if "target" in (self.direction, self.normalization.split("_")[0]) and (
            self.target_value is None or not self.target_tolerance
        ):
            raise ValueError("a target needs a value and a tolerance")


def normalized_weights(objectives: Sequence[Objective]) -> dict[str, float]:
    """Weights summing to one; equal weights when all are zero."""
    if len({o.objective_id for o in objectives}) != len(objectives):
        raise ValueError("objective ids must be unique")
    total = sum(o.weight for o in objectives)
    if total <= 0:
        return {o.objective_id: 1.0 / len(objectives) for o in objectives}
    return {o.objective_id: o.weight / total for o in objectives}


def objective_table(spark: SparkSession, objectives: Sequence[Objective]) -> DataFrame:
    weights = normalized_weights(objectives)
    rows = [
        (o.objective_id, o.metric, o.direction, o.normalization, weights[o.objective_id], float(o.weight),
         o.target_value, o.target_tolerance)
        for o in objectives
    ]
    return spark.createDataFrame(
        rows,
        "objective_id string, metric string, direction string, normalization string, weight double, "
        "raw_weight double, target_value double, target_tolerance double",
    )


def _literal_scopes(objectives: Sequence[Objective]) -> Column:
    cells = [
        F.struct(
            F.lit(o.objective_id).alias("objective_id"),
            F.lit(o.scope.kind).alias("kind"),
            F.lit(o.scope.start).cast("double").alias("a"),
            F.lit(o.scope.end).cast("double").alias("b"),
            F.lit(o.scope.event_type).cast("string").alias("event_type"),
            F.lit(o.scope.selection).alias("selection"),
            F.lit(o.scope.skip_empty).alias("skip_empty"),
        )
        for o in objectives
    ]
    return F.explode(F.array(*cells))


def resolve_windows(
    samples: DataFrame,
    durations: DataFrame,
    objectives: Sequence[Objective],
    events: DataFrame | None = None,
    bucket: float = 1.0,
) -> DataFrame:
    """Half-open window of every objective on every run, with a reason where there is none.

    ``samples`` is ``run_id, t``; ``events`` is ``run_id, event_type, start_t, end_t``.
    """
    spans = samples.groupBy("run_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    asked = spans.join(durations, "run_id", "left").withColumn("s", _literal_scopes(objectives))
    asked = asked.select("run_id", "_first", "_last", "duration", "s.*")
    needs = [o for o in objectives if o.scope.kind.startswith("event")]
    start_at, end_at = F.lit(None).cast("double"), F.lit(None).cast("double")
    if needs:
        if events is None:
            raise ValueError("an event scope needs an events table")
        scoped = events.select("run_id", "event_type", "start_t", "end_t", _literal_scopes(needs).alias("s")).where(
            F.col("event_type") == F.col("s.event_type")
        )
        relative = F.col("s.kind") == "event_relative"
        scoped = scoped.select(
            "run_id", "start_t", "end_t", "s.objective_id", "s.selection", "s.skip_empty",
            F.when(relative, F.col("start_t") + F.col("s.a")).otherwise(F.col("start_t")).alias("w0"),
            F.when(relative, F.col("start_t") + F.col("s.b")).otherwise(F.col("end_t")).alias("w1"),
        )
        keep = scoped.where(~F.col("skip_empty"))
        if any(o.scope.skip_empty for o in needs):
            # Only occurrences that hold a sample; the stab join finds them per bucket.
            picky = scoped.where("skip_empty")
            filled = stab_join(
                samples.select("run_id", "t"), picky.select("run_id", "objective_id", "w0", "w1"),
                ["run_id"], "t", ("w0", "w1"), bucket,
            ).select("run_id", "objective_id", "w0", "w1").distinct()
            keep = keep.unionByName(picky.join(filled, ["run_id", "objective_id", "w0", "w1"], "left_semi"))
        pick = F.struct("w0", "w1")
        order = (
            F.when(F.col("selection") == "first", F.struct(F.col("start_t").alias("x"), F.col("end_t").alias("y")))
            .when(F.col("selection") == "last", F.struct((-F.col("start_t")).alias("x"), (-F.col("end_t")).alias("y")))
            .otherwise(F.struct((F.col("start_t") - F.col("end_t")).alias("x"), F.col("start_t").alias("y")))
        )
        found = keep.groupBy("run_id", "objective_id").agg(F.min_by(pick, order).alias("_w"))
        asked = asked.join(found, ["run_id", "objective_id"], "left")
        start_at, end_at = F.col("_w.w0"), F.col("_w.w1")
    kind = F.col("kind")
    start = (
        F.when(kind == "full", F.col("_first")).when(kind == "absolute", F.col("a"))
        .when(kind == "normalized", F.col("a") * F.col("duration")).otherwise(start_at)
    )
    end = (
        F.when(kind == "full", F.col("_last") + 1e-9).when(kind == "absolute", F.col("b"))
        .when(kind == "normalized", F.col("b") * F.col("duration")).otherwise(end_at)
    )
    out = asked.withColumn("start_t", start).withColumn("end_t", end)
    reason = (
        F.when((kind == "normalized") & ~(F.coalesce("duration", F.lit(0.0)) > 0), "no duration")
        .when(F.col("start_t").isNull(), "no such event")
        .when(F.col("end_t") <= F.col("start_t"), "empty window")
    )
    return out.select("run_id", "objective_id", "start_t", "end_t", reason.alias("reason"))


def target_series(panel: DataFrame, objectives: Sequence[Objective], unit: str = "unit_id") -> DataFrame:
    """Series of each objective's target: mean of its units per step.

    The unit sets are part of the specification, so each cell is tagged with the objectives
    it serves in one projection; no join.
    """
    tags = F.array_compact(
        F.array(
            *[
                F.lit(o.objective_id) if o.units is None
                else F.when(F.col(unit).isin(list(o.units)), F.lit(o.objective_id))
                for o in objectives
            ]
        )
    )
    cells = panel.withColumn("objective_id", F.explode(tags))
    return cells.groupBy("run_id", "objective_id", "row_idx", "t").agg(F.avg("value").alias("value"))


def region_target_series(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Same for targets given as a table ``objective_id, unit_id`` (region, network, hemisphere)."""
    return panel.join(targets, "unit_id").groupBy("run_id", "objective_id", "row_idx", "t").agg(
        F.avg("value").alias("value"), F.count("value").alias("units")
    )


def windowed(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples of each objective inside its own window on each run."""
    spans = windows.where("reason IS NULL").select("run_id", "objective_id", "start_t", "end_t")
    return (
        series.join(spans, ["run_id", "objective_id"])
        .where((F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("end_t")))
        .drop("start_t", "end_t")
    )


def evaluate(
    series: DataFrame, windows: DataFrame, objectives: Sequence[Objective], width: float | None = None,
    baseline_run: str | int | None = None, panel: DataFrame | None = None, reference: DataFrame | None = None,
) -> DataFrame:
    """Raw value of every objective on every run, one grouped pass for all metrics of one series.

    Rows without a value carry a reason. Metrics with a second input need it: a divergence the
    ``baseline_run``, a pattern similarity the unit ``panel`` and ``reference`` (unit_id,
    ref_value); they are refused without it.
    """
    by_metric = {o.objective_id: o.metric for o in objectives}
    diverging = [i for i, m in by_metric.items() if m == "DIVERGENCE_FROM_BASELINE"]
    alike = [i for i, m in by_metric.items() if m == "PATTERN_SIMILARITY_TO_REFERENCE"]
    if diverging and baseline_run is None:
        raise ValueError("DIVERGENCE_FROM_BASELINE needs a baseline run")
    if alike and (panel is None or reference is None):
        raise ValueError("PATTERN_SIMILARITY_TO_REFERENCE needs a panel and a reference")
    inside = windowed(series, windows).where(F.col("value").isNotNull())
    stepped = neighbours(inside, ["run_id", "objective_id"], ["t"], ["value", "t"], width)
    names = sorted(set(by_metric.values()))
    # Registered builders look one column deep, so every metric is one aggregate.
    sums = in_order(stepped, ["run_id", "objective_id"], ["row_idx"], width).groupBy("run_id", "objective_id").agg(
        F.count("value").alias("samples"),
        F.max_by("t", F.struct("value", -F.col("t"))).alias("peak_t"),
        *[METRICS.get(n).build().alias(f"_m{i}") for i, n in enumerate(names)],
    )
    value = F.lit(None).cast("double")
    for i, m in by_metric.items():
        value = F.when(F.col("objective_id") == i, F.col(f"_m{names.index(m)}")).otherwise(value)
    out = windows.join(sums, ["run_id", "objective_id"], "left").withColumn("raw_value", value)
    why = F.col("reason")
    others = []
    if diverging:
        others.append(divergence_from_baseline(inside.where(F.col("objective_id").isin(diverging)), baseline_run, width).select(
            "run_id", "objective_id", F.col("raw_value").alias("_other"), F.col("reason").alias("_why")))
    for i in alike:
        of_one = windows.where(F.col("objective_id") == i).select("run_id", "start_t", "end_t")
        cells = panel.join(of_one, "run_id").where("t >= start_t AND t < end_t").select("run_id", "row_idx", "unit_id", "value")
        others.append(pattern_similarity(cells, reference).select(
            "run_id", F.lit(i).alias("objective_id"), F.col("raw_value").alias("_other"), F.lit(None).cast("string").alias("_why")))
    if others:
        both = others[0]
        for other in others[1:]:
            both = both.union(other)
        out = out.join(both, ["run_id", "objective_id"], "left").withColumn("raw_value", F.coalesce("raw_value", "_other"))
        why = F.coalesce("reason", "_why")
    reason = (
        F.when(why.isNotNull(), why)
        .when(F.col("samples").isNull(), "no samples in window")
        .when(F.col("raw_value").isNull(), "too few samples")
    )
    return out.select(
        "run_id", "objective_id", "start_t", "end_t", F.coalesce("samples", F.lit(0)).alias("samples"), "peak_t",
        "raw_value", F.col("raw_value").isNotNull().alias("valid"), reason.alias("reason"),
    )


def contributions(
    series: DataFrame, windows: DataFrame, objectives: Sequence[Objective], width: float | None = None
) -> DataFrame:
    """Share of each sample in the raw value, for metrics that are sums over samples.

    Mean: v / n. Peak: all on the earliest maximum. Integral: half of both adjacent areas.
    ``total`` repeats the metric, so ``sum(contribution) = total`` can be checked.
    """
    keys = ["run_id", "objective_id"]
    inside = windowed(series, windows).where(F.col("value").isNotNull())
    near = neighbours(inside, keys, ["t"], ["value", "t"], width, lead=True)
    facts = inside.groupBy(*keys).agg(
        F.count("value").alias("_n"), F.max_by("t", F.struct("value", -F.col("t"))).alias("_peak_t")
    )
    v, t = F.col("value"), F.col("t")
    area = lambda n: (v + F.col(f"{n}.value")) / 2 * F.abs(t - F.col(f"{n}.t"))
    half = (F.coalesce(area("prev"), F.lit(0.0)) + F.coalesce(area("next"), F.lit(0.0))) / 2
    by_metric = {
        "MEAN_RESPONSE": v / F.col("_n"),
        "PEAK_RESPONSE": F.when(t == F.col("_peak_t"), v).otherwise(F.lit(0.0)),
        "INTEGRATED_RESPONSE": F.when(F.col("_n") >= 2, half),
    }
    share = F.lit(None).cast("double")
    for o in objectives:
        if o.metric in by_metric:
            share = F.when(F.col("objective_id") == o.objective_id, by_metric[o.metric]).otherwise(share)
    return (
        near.join(facts, keys).withColumn("contribution", share)
        .where(F.col("contribution").isNotNull()).select(*keys, "row_idx", "t", "value", "contribution")
    )


def divergence_from_baseline(
    inside: DataFrame, baseline_run: str | int, width: float | None = None
) -> DataFrame:
    """RMS difference from the baseline run, paired by position inside each side's window."""
    keys = ["run_id", "objective_id"]
    placed = ordinal(inside, keys, ["t"], "_i", width)
    base = placed.where(F.col("run_id") == F.lit(baseline_run)).select(
        "objective_id", "_i", F.col("value").alias("_base")
    )
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base_n = base.groupBy("objective_id").agg(F.count(F.lit(1)).alias("_bn"))
    d = F.col("value") - F.col("_base")
    pairs = placed.join(base, ["objective_id", "_i"], "left").groupBy(*keys).agg(
        F.sqrt(F.avg(d * d)).alias("_rms"), F.avg(d).alias("_mean"), F.max(F.abs(d)).alias("_max")
    )
    same = F.col("_n") == F.col("_bn")
    return pairs.join(sizes, keys).join(base_n, "objective_id", "left").select(
        *keys,
        F.when(same, F.col("_rms")).alias("raw_value"),
        F.when(same, F.col("_mean")).alias("mean_signed_difference"),
        F.when(same, F.col("_max")).alias("max_absolute_difference"),
        F.when(F.col("_bn").isNull(), "no baseline").when(~same, "window lengths differ").alias("reason"),
    )


def pattern_similarity(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Cosine of each run's mean unit pattern over fully finite rows with ``unit_id, ref_value``."""
    units = panel.agg(F.countDistinct("unit_id").alias("n")).scalar()
    full = panel.groupBy("run_id", "row_idx").agg(F.count("value").alias("_c")).where(F.col("_c") == units)
    mean = panel.join(full.select("run_id", "row_idx"), ["run_id", "row_idx"], "left_semi").groupBy(
        "run_id", "unit_id"
    ).agg(F.avg("value").alias("m"))
    a, b = F.col("m"), F.col("ref_value")
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return mean.join(reference, "unit_id").where(b.isNotNull()).groupBy("run_id").agg(
        F.when(norm > 0, F.sum(a * b) / norm).alias("raw_value"), F.count(F.lit(1)).alias("compared_units")
    )


def regional_contribution(panel: DataFrame, unit_map: DataFrame, start: float, end: float) -> DataFrame:
    """Mean over window and units per region, its share of the summed magnitude, unit count."""
    inside = panel.where((F.col("t") >= start) & (F.col("t") < end))
    regions = inside.join(unit_map.where("region_id IS NOT NULL").select("unit_id", "region_id"), "unit_id")
    means = regions.groupBy("run_id", "region_id").agg(
        F.avg("value").alias("mean_value"), F.countDistinct("unit_id").alias("units")
    )
    total = means.groupBy("run_id").agg(F.sum(F.abs("mean_value")).alias("_total"))
    return means.join(total, "run_id").where("_total > 0").select(
        "run_id", "region_id", "mean_value", "units", (F.abs("mean_value") / F.col("_total")).alias("share")
    )


def normalise(
    raw: DataFrame, objectives: Sequence[Objective], baseline_run: str | int | None = None
) -> DataFrame:
    """Normalise raw values across the variants of each objective and apply its direction.

    Statistics per objective are one grouped row each (few objectives), joined back to the
    scores; nothing gathers all variants of an objective in one task.
    """
    spec = objective_table(raw.sparkSession, objectives)
    v = F.col("raw_value")
    stats = raw.groupBy("objective_id").agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"),
        F.max(F.when(F.col("run_id") == F.lit(baseline_run), v)).alias("_base"),
    )
    if any(o.normalization == "robust" for o in objectives):
        robust = [o.objective_id for o in objectives if o.normalization == "robust"]
        q = exact_quantiles(
            raw.where(F.col("objective_id").isin(robust)), ["objective_id"], "raw_value", {"_p10": 0.1, "_p90": 0.9}
        )
        stats = stats.join(q, "objective_id", "left")
    else:
        stats = stats.withColumn("_p10", F.lit(None).cast("double")).withColumn("_p90", F.lit(None).cast("double"))
    joined = raw.join(spec, "objective_id").join(stats, "objective_id")
    closeness = lambda x: F.greatest(
        F.lit(0.0), 1 - F.abs(x - F.col("target_value")) / F.col("target_tolerance")
    )
    spread, robust_span = F.col("_hi") - F.col("_lo"), F.col("_p90") - F.col("_p10")
    strategy = F.col("normalization")
    normal = (
        F.when(v.isNull(), None)
        .when(strategy == "none", v)
        .when(strategy == "min_max", F.when(spread <= 0, F.lit(0.5)).otherwise((v - F.col("_lo")) / spread))
        .when(strategy == "z_score", F.when(F.col("_sd") <= 0, F.lit(0.0)).otherwise((v - F.col("_mean")) / F.col("_sd")))
        .when(
            strategy == "baseline",
            F.when(F.abs("_base") < 1e-12, v - F.col("_base")).otherwise((v - F.col("_base")) / F.abs("_base")),
        )
        .when(
            strategy == "robust",
            F.when(robust_span <= 0, F.lit(0.5)).otherwise(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_p10")) / robust_span))
            ),
        )
        .when(strategy == "target_distance", closeness(v))
    )
    scored = joined.withColumn("normalized", normal)
    n = F.col("normalized")
    score = (
        F.when(n.isNull(), None)
        .when(F.col("direction") == "maximize", n)
        .when(F.col("direction") == "minimize", -n)
        .when(strategy == "target_distance", n)
        .otherwise(closeness(n))
    )
    return scored.withColumn("score", score).select(
        *raw.columns, "normalized", "score", "weight", "raw_weight", "direction", "normalization"
    )


def composite(scores: DataFrame, n_objectives: int) -> DataFrame:
    """Weighted sum per variant; NULL unless every objective has a score."""
    c = F.col("weight") * F.col("score")
    complete = F.count("score") == n_objectives
    return scores.groupBy("run_id").agg(
        F.when(complete, F.sum(c)).alias("total_score"),
        F.when(complete, F.sum(F.abs(c))).alias("magnitude"),
        F.count("score").alias("scored_objectives"),
    )


def contribution_shares(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Each objective's part of a complete variant's composite."""
    c = F.col("weight") * F.col("score")
    return scores.join(totals.where("total_score IS NOT NULL"), "run_id").select(
        "run_id", "objective_id", c.alias("contribution"),
        F.when(F.col("magnitude") > 0, F.abs(c) / F.col("magnitude")).alias("fraction"), "weight",
    )


def effective_weights(shares: DataFrame) -> DataFrame:
    """Realised share of the composite per objective, and whether it drifts from the stated weight."""
    return shares.where(F.col("fraction").isNotNull()).groupBy("objective_id").agg(
        F.avg("fraction").alias("effective_weight"), F.first("weight").alias("stated_weight")
    ).withColumn("drifts", F.abs(F.col("effective_weight") - F.col("stated_weight")) > WEIGHT_DRIFT)


def rank_variants(totals: DataFrame, baseline_run: str | int | None = None) -> DataFrame:
    """Rank complete variants (score, then id); add the difference from the baseline."""
    keyed = totals.withColumn("_all", F.lit(0))
    scored = ranked(
        keyed.where("total_score IS NOT NULL"), ["_all"], [F.col("total_score").desc(), F.col("run_id").asc()], "rank"
    )
    rest = keyed.where("total_score IS NULL").withColumn("rank", F.lit(None).cast("int"))
    out = scored.unionByName(rest)
    if baseline_run is None:
        return out.drop("_all")
    base = keyed.where(F.col("run_id") == F.lit(baseline_run)).select("_all", F.col("total_score").alias("_base"))
    delta = F.col("total_score") - F.col("_base")
    return (
        out.join(base, "_all", "left")
        .withColumn("baseline_delta", delta)
        .withColumn("baseline_relative", ratio(delta, F.abs("_base")))
        .drop("_all", "_base")
    )


def score_experiment(
    series: DataFrame,
    windows: DataFrame,
    objectives: Sequence[Objective],
    baseline_run: str | int | None = None,
    width: float | None = None,
    panel: DataFrame | None = None,
    reference: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores per variant and objective, ranked totals per variant).

    Raw values (one row per variant and objective) are written once: statistics, percentiles,
    composites and ranks all read them, and the panel is scanned a single time.
    """
    raw = durable(evaluate(series, windows, objectives, width, baseline_run, panel, reference))
    scores = normalise(raw, objectives, baseline_run)
    totals = durable(composite(scores, len(objectives)))
    return scores, rank_variants(totals, baseline_run)


def sweep_weights(scores: DataFrame, objectives: Sequence[Objective], steps: int = 21) -> DataFrame:
    """Winner and margin as each objective's weight goes 0..1, the rest keeping proportions.

    Only complete variants take part. Weights are literals, so each variant's 21 x k totals
    are one projection; the two best per step are picked with per-group limits.
    """
    ids = [o.objective_id for o in objectives]
    complete = (
        scores.groupBy("run_id")
        .agg(F.count("score").alias("_c"), *[F.max(F.when(F.col("objective_id") == i, F.col("score"))).alias(f"_s{k}") for k, i in enumerate(ids)])
        .where(F.col("_c") == len(ids))
    )
    cells = []
    for k, o in enumerate(objectives):
        rest = sum(x.weight for x in objectives if x is not o)
        for step in range(steps):
            w = step / (steps - 1)
            total = F.lit(w) * F.col(f"_s{k}")
            for j, x in enumerate(objectives):
                if j != k:
                    share = x.weight / rest if rest > 0 else 1.0 / (len(objectives) - 1)
                    total = total + F.lit((1 - w) * share) * F.col(f"_s{j}")
            cells.append(
                F.struct(F.lit(o.objective_id).alias("swept"), F.lit(step).alias("step"), total.alias("total"))
            )
    long = complete.select("run_id", F.explode(F.array(*cells)).alias("c")).select("run_id", "c.*")
    two = top_k(long, ["swept", "step"], [F.col("total").desc(), F.col("run_id")], 2, "_k")
    best = two.groupBy("swept", "step").agg(
        F.max(F.when(F.col("_k") == 1, F.col("run_id"))).alias("winner"),
        (F.max(F.when(F.col("_k") == 1, F.col("total"))) - F.max(F.when(F.col("_k") == 2, F.col("total")))).alias("margin"),
    )
    before = F.lag("winner").over(Window.partitionBy("swept").orderBy("step"))
    return best.withColumn("weight", F.col("step") / F.lit(float(steps - 1))).withColumn(
        "flip", F.coalesce(before != F.col("winner"), F.lit(False))
    )


def score_matrix(scores: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Variants x objectives; the pivot values are given, so no extra pass finds them."""
    return scores.groupBy("run_id").pivot("objective_id", list(ids)).agg(F.first("score"))


def explain_top_two(scores: DataFrame, ranking: DataFrame) -> DataFrame:
    """The two best variants overall, side by side per objective with the measured difference.

    ``leader`` is whichever of the two scores higher on that objective; the better rank wins a
    tie, and a variant without a score comes second.
    """
    top = ranking.where("rank <= 2").select("run_id", "rank")
    facts = F.struct("run_id", "raw_value", "score", "peak_t")
    place = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(0.0)), -F.col("rank"))
    pair = scores.join(top, "run_id").groupBy("objective_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(facts, place).alias("a"), F.min_by(facts, place).alias("b")
    )
    second = lambda c: F.when(F.col("_n") > 1, F.col(f"b.{c}"))
    wide = pair.select(
        "objective_id", F.col("a.run_id").alias("leader"), second("run_id").alias("runner_up"),
        F.col("a.raw_value").alias("leader_raw"), second("raw_value").alias("runner_up_raw"),
        F.col("a.score").alias("leader_score"), second("score").alias("runner_up_score"),
        F.col("a.peak_t").alias("leader_peak_t"),
    )
    high, low = F.greatest("leader_raw", "runner_up_raw"), F.least("leader_raw", "runner_up_raw")
    both = F.col("leader_raw").isNotNull() & F.col("runner_up_raw").isNotNull()
    out = wide.withColumn("difference", F.when(both, high - low)).withColumn(
        "relative_difference", F.when(both, ratio(high - low, F.abs(low)))
    )
    text = F.format_string(
        "%s: variant %s measured %.4f against %.4f for variant %s.", F.col("objective_id"), F.col("leader").cast("string"),
        F.col("leader_raw"), F.col("runner_up_raw"), F.col("runner_up").cast("string"),
    )
    return out.withColumn("statement", F.when(both, text))


def select_occurrence(events: DataFrame, keys: Sequence[str], selection: str) -> DataFrame:
    """First, last or longest interval of each group (earliest start breaks ties)."""
    order = {
        "first": F.struct("start_t", "end_t"),
        "last": F.struct(-F.col("start_t"), -F.col("end_t")),
        "longest": F.struct(F.col("start_t") - F.col("end_t"), F.col("start_t")),
    }[selection]
    return events.groupBy(*keys).agg(F.min_by(F.struct("start_t", "end_t"), order).alias("e")).select(
        *keys, "e.start_t", "e.end_t"
    )


