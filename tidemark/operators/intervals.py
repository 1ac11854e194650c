"""Labelled intervals: boundaries, fusion into one timeline, runs, merges and coverage.

Intervals are half-open ``[start_t, end_t)`` per run. Runs may be any size: every ordered
step goes through ``sequence`` (chunked) and every range condition through ``timejoin``
(bucketed).
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import safe_div
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.sequence import fold_sorted, islands, neighbours, running
from tidemark.operators.timejoin import asof, overlap_join, stab_join
from tidemark.session import durable

SLACK = 1e-6

# Detector vocabulary that counts as a product, and its shortest reveal.
PRODUCT_LABELS = (
    "a product package", "a bottle", "a computer", "a mobile phone", "a car", "a logo",
    "a book", "food", "a drink",
)
MIN_REVEAL_SECONDS = 0.5


def boundaries(intervals: DataFrame, durations: DataFrame) -> DataFrame:
    """Every interval endpoint of a run plus 0 and its duration, clamped, distinct."""
    ends = intervals.select("run_id", F.explode(F.array("start_t", "end_t")).alias("t"))
    fixed = durations.select("run_id", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("t"))
    points = ends.unionByName(fixed).join(durations, "run_id")
    inside = points.where((F.col("t") >= -SLACK) & (F.col("t") <= F.col("duration") + SLACK))
    clamped = F.round(F.least(F.greatest(F.col("t"), F.lit(0.0)), F.col("duration")), 6)
    return inside.select("run_id", clamped.alias("t")).distinct()


def spans_between(points: DataFrame, width: float | None = None) -> DataFrame:
    """Consecutive spans between the boundaries of each run."""
    return (
        neighbours(points, ["run_id"], ["t"], ["t"], width, lead=True)
        .where(F.col("next").isNotNull())
        .select("run_id", F.col("t").alias("span_start"), F.col("next.t").alias("span_end"))
    )


def spans_to(points: DataFrame, durations: DataFrame, width: float | None = None) -> DataFrame:
    """Spans from each boundary to the next one, the last ending at the run's duration."""
    nxt = neighbours(points, ["run_id"], ["t"], ["t"], width, lead=True).join(durations, "run_id")
    end = F.least(F.coalesce(F.col("next.t"), F.col("duration")), F.col("duration"))
    return nxt.withColumn("end_t", end).withColumnRenamed("t", "start_t").drop("prev", "next", "duration")


def interval_label(cta: Column, speech: Column, text: Column, audio: Column) -> Column:
    """Most distinctive property first: call to action, speech, text, silence, music."""
    return (
        F.when(cta, "cta")
        .when(speech, "speech_segment")
        .when(text, "text_overlay")
        .when(audio == "silence", "silence")
        .when(audio == "music", "music_segment")
        .otherwise("fused_interval")
    )


def fuse(
    spans: DataFrame, intervals: DataFrame, signals: DataFrame, bucket: float
) -> DataFrame:
    """One row per span of a run: what overlaps it, its label, its signal mean.

    ``intervals`` has ``kind, idx, start_t, end_t, label, text``; ``signals`` has ``t, value``.
    """
    key = ["run_id", "span_start", "span_end"]
    hits = overlap_join(
        spans, intervals, ["run_id"], ("span_start", "span_end"), ("start_t", "end_t"), bucket, SLACK
    )
    has = lambda k: F.max(F.when(F.col("kind") == k, True).otherwise(False))
    length = F.least("span_end", "end_t") - F.greatest("span_start", "start_t")
    audio_key = F.when(F.col("kind") == "audio", F.struct(length, -F.col("start_t"), -F.col("idx")))
    spoken = F.array_sort(
        F.collect_list(F.when(F.col("kind") == "speech", F.struct("start_t", "idx", "text")))
    )
    shown = F.array_sort(
        F.collect_list(F.when(F.col("kind") == "overlay", F.struct("start_t", "idx", "text")))
    )
    facts = hits.groupBy(*key).agg(
        has("shot").alias("has_shot"),
        has("audio").alias("has_audio"),
        has("speech").alias("has_speech"),
        has("overlay").alias("has_overlay"),
        has("cta").alias("has_cta"),
        F.max_by("label", audio_key).alias("audio_label"),
        F.transform(spoken, lambda s: s["text"]).alias("spoken"),
        F.transform(shown, lambda s: s["text"]).alias("shown"),
        F.min(F.when(F.col("kind") == "shot", F.col("idx"))).alias("first_shot"),
    )
    means = interval_means(signals, spans, ("span_start", "span_end"), bucket)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = spans.join(facts, key, "left").join(means, key, "left")
    return out.select(
        *key,
        interval_label(flag("has_cta"), flag("has_speech"), flag("has_overlay"), F.col("audio_label")).alias(
            "event_type"
        ),
        F.array_compact(
            F.array(
                F.when(flag("has_shot"), "visual"),
                F.when(flag("has_audio"), "audio"),
                F.when(flag("has_speech"), "speech"),
                F.when(flag("has_overlay"), "on_screen_text"),
            )
        ).alias("modalities"),
        "audio_label",
        F.coalesce(F.array_join("spoken", " "), F.lit("")).alias("speech_text"),
        F.coalesce(F.col("shown"), F.array().cast("array<string>")).alias("on_screen_text"),
        "first_shot",
        "signal_mean",
        F.coalesce("signal_samples", F.lit(0)).alias("signal_samples"),
    )


def interval_means(
    signals: DataFrame, spans: DataFrame, span: tuple[str, str], bucket: float
) -> DataFrame:
    """Mean of a signal over each ``[start, end)`` with its sample count."""
    slim = spans.select("run_id", *span)
    return (
        stab_join(signals.select("run_id", "t", "value"), slim, ["run_id"], "t", span, bucket)
        .groupBy("run_id", *span)
        .agg(F.avg("value").alias("signal_mean"), F.count("value").alias("signal_samples"))
    )


def event_at(points: DataFrame, spans: DataFrame, t: str, bucket: float) -> DataFrame:
    """The interval of a contiguous timeline that holds each point; the last one is closed."""
    ends = spans.groupBy("run_id").agg(F.max("span_end").alias("_last"))
    marked = spans.join(ends, "run_id").withColumn(
        "_reach", F.when(F.col("span_end") == F.col("_last"), F.col("span_end") + SLACK).otherwise(F.col("span_end"))
    )
    return stab_join(points, marked, ["run_id"], t, ("span_start", "_reach"), bucket).where(
        (F.col(t) < F.col("span_end")) | (F.col(t) == F.col("_last"))
    ).drop("_last", "_reach")


def partition_violations(spans: DataFrame, width: float | None = None) -> DataFrame:
    """Places where a timeline has a gap or an overlap of more than the slack."""
    seen = neighbours(spans, ["run_id"], ["span_start"], ["span_end"], width)
    gap = F.col("span_start") - F.col("prev.span_end")
    return seen.where(F.abs(gap) > SLACK).select("run_id", "span_start", gap.alias("gap"))


def covered_length(intervals: DataFrame, durations: DataFrame, width: float | None = None) -> DataFrame:
    """Seconds covered by possibly overlapping intervals, clamped to the run."""
    clipped = (
        intervals.where(F.col("end_t") > F.col("start_t"))
        .join(durations, "run_id")
        .select(
            "run_id",
            F.greatest(F.lit(0.0), "start_t").alias("s"),
            F.least("duration", "end_t").alias("e"),
        )
    )
    seen = running(clipped, ["run_id"], ["s", "e"], {"reach": ("max", "e")}, width, exclusive=True)
    fresh = F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce("reach", F.col("s"))))
    return seen.groupBy("run_id").agg(F.sum(fresh).alias("covered"))


def content_summary(
    durations: DataFrame, intervals: DataFrame, scenes: DataFrame, signals: DataFrame,
    width: float | None = None, minutes_per_unit: float = 1 / 60,
) -> DataFrame:
    """One row a run: pace of shots, scenes, spoken words, and shares of speech, sound, silence and music.

    ``intervals`` has kinds shot, speech, audio (label silence or music), overlay and cta with
    ``text``; ``scenes`` a row a scene; ``signals`` has ``value``. Shares come from merged
    intervals within the run, of all families in one pass, 0 where there are none. Shots without
    length count as shots, not in their mean and median. Without shots the pace is null, without
    words the rate of words, and a run without length has null shares. Times are in seconds
    unless ``minutes_per_unit`` says otherwise.
    """
    of_kind = lambda k, c: F.when(F.col("kind") == k, c)
    length = F.when(F.col("end_t") > F.col("start_t"), F.col("end_t") - F.col("start_t"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    counts = intervals.groupBy("run_id").agg(
        F.count(of_kind("shot", 1)).alias("shot_count"), F.avg(of_kind("shot", length)).alias("mean_shot"),
        F.count(of_kind("speech", 1)).alias("utterances"), F.coalesce(F.sum(of_kind("speech", words)), F.lit(0)).alias("word_count"),
        F.count(of_kind("overlay", 1)).alias("overlay_count"), F.count(of_kind("cta", 1)).alias("cta_count"),
        F.min(of_kind("cta", F.col("start_t"))).alias("first_cta"),
    )
    shots = intervals.where("kind = 'shot'").select("run_id", length.alias("length")).where("length IS NOT NULL")
    median = exact_quantiles(shots, ["run_id"], "length", {"median_shot": 0.5})
    families = ("speech", "audio", "silence", "music")
    family = F.when(F.col("kind") == "speech", F.array(F.lit("speech"))).when(F.col("kind") == "audio", F.array(F.lit("audio"), F.col("label")))
    heard = intervals.where("kind IN ('speech', 'audio')").withColumn("family", F.explode(family)).where(F.col("family").isin(*families))
    both = F.struct("run_id", "family").alias("run_id")
    lengths = durations.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families]))).select(both, "duration")
    covered = covered_length(heard.select(both, "start_t", "end_t"), lengths, width)
    share = lambda f: F.sum(F.when(F.col("run_id.family") == f, F.col("covered"))).alias(f"_{f}")
    covered = covered.groupBy(F.col("run_id.run_id").alias("run_id")).agg(*[share(f) for f in families])
    out = durations.select("run_id", "duration").join(counts, "run_id", "left").join(median, "run_id", "left")
    out = out.join(scenes.groupBy("run_id").agg(F.count("*").alias("scene_count")), "run_id", "left").join(covered, "run_id", "left")
    out = out.join(signals.groupBy("run_id").agg(F.avg("value").alias("mean_signal")), "run_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = F.when(F.col("duration") > 0, F.col("duration"))
    minutes = whole * minutes_per_unit
    return out.select(
        "run_id", *[number(c) for c in ("shot_count", "scene_count", "utterances", "word_count", "overlay_count", "cta_count")],
        "mean_shot", "median_shot", F.when(F.col("shot_count") > 0, (F.col("shot_count") - 1) / minutes).alias("cuts_per_minute"),
        F.when(F.col("word_count") > 0, F.col("word_count") / minutes).alias("words_per_minute"), "first_cta", "mean_signal",
        *[(F.coalesce(f"_{f}", F.lit(0.0)) / whole).alias(f"{f}_fraction") for f in families],
    )


def run_segments(
    frames: DataFrame, durations: DataFrame, order: Sequence[str], width: float | None = None
) -> DataFrame:
    """Equal neighbouring labels become segments; the first starts at 0, the last ends at the duration."""
    label = F.col("label")
    grouped = islands(frames, ["run_id"], order, lambda p: label != p["label"], ["label"], width)
    runs = grouped.groupBy("run_id", "island").agg(
        F.min("t").alias("_s"), F.first("label").alias("label"), F.avg("value").alias("mean_value"),
        F.count(F.lit(1)).alias("frames"),
    )
    nxt = neighbours(runs, ["run_id"], ["_s"], ["_s"], width, lead=True).join(durations, "run_id")
    return nxt.select(
        "run_id",
        "label",
        F.when(F.col("prev").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), "_s")).alias("start_t"),
        F.least(F.coalesce(F.col("next._s"), F.col("duration")), F.col("duration")).alias("end_t"),
        "mean_value",
        "frames",
    )


def absorb_short(segments: DataFrame, minimum: float, width: float | None = None) -> DataFrame:
    """Absorb segments shorter than ``minimum`` into the longer neighbour, leftmost first.

    Two adjacent long segments never merge, so a run is cut there and each piece is a fold
    that holds at most two segments.
    """
    length = F.col("end_t") - F.col("start_t")
    cut = islands(
        segments, ["run_id"], ["start_t"],
        lambda p: (length >= minimum) & (p["end_t"] - p["start_t"] >= minimum), ["start_t", "end_t"], width,
    )

    def size(x: tuple) -> float:
        return x[1] - x[0]

    def absorb(keeper: tuple, gone: tuple) -> tuple:
        total = size(keeper) + size(gone)
        mean = (keeper[3] * size(keeper) + gone[3] * size(gone)) / total if total else keeper[3]
        return (min(keeper[0], gone[0]), max(keeper[1], gone[1]), keeper[2], mean)

    def step(state, seg):
        left, cur = state or (None, None)
        out = []
        if cur is not None:
            if left is not None and size(left) >= size(seg):
                left, cur = absorb(left, cur), None
            else:
                seg, cur = absorb(seg, cur), None
        if size(seg) < minimum:
            return (left, seg), out
        if left is not None:
            out.append(left)
        return (seg, None), out

    def finish(state):
        left, cur = state
        if left is None:
            return [cur]
        return [absorb(left, cur) if cur is not None else left]

    schema = "run_id {}, island bigint, start_t double, end_t double, label string, mean_value double".format(
        segments.schema["run_id"].dataType.simpleString()
    )
    return fold_sorted(
        cut.withColumn("island", F.col("island").cast("long")), ["run_id", "island"],
        ["start_t", "end_t", "label", "mean_value"], step, finish,
        ["run_id", "island", "start_t", "end_t", "label", "mean_value"], schema,
    ).drop("island")


def merge_short_spans(spans: DataFrame, minimum: float, width: float | None = None) -> DataFrame:
    """Spans below ``minimum`` join the span before them, which keeps its own start and label.

    A merged span starts with a long one (or is the run's first), so it can never be short
    again: the rule is plain gaps-and-islands.
    """
    grouped = islands(
        spans, ["run_id"], ["start_t"], lambda p: F.col("end_t") - F.col("start_t") >= minimum,
        ["start_t"], width,
    )
    return grouped.groupBy("run_id", "island").agg(
        F.min("start_t").alias("start_t"),
        F.max("end_t").alias("end_t"),
        F.min_by("label", "start_t").alias("label"),
        F.count(F.lit(1)).alias("merged"),
    ).drop("island")


def cluster_boundaries(
    points: DataFrame, tolerance: float, width: float | None = None
) -> DataFrame:
    """Near-coincident boundaries collapse to the first of their group.

    The group is anchored at its first member, so it is a fold; a gap above the tolerance
    always opens a group, which is where a run is cut. An opening at 0 is always present.
    """
    cut = islands(points, ["run_id"], ["t", "detector"], lambda p: F.col("t") - p["t"] > tolerance, ["t"], width)

    def step(state, row):
        t, detector = row
        if state is None:
            return (t, {detector}), []
        if t - state[0] <= tolerance:
            state[1].add(detector)
            return state, []
        return (t, {detector}), [(state[0], sorted(state[1]))]

    kind = points.schema["run_id"].dataType.simpleString()
    groups = fold_sorted(
        cut.withColumn("island", F.col("island").cast("long")), ["run_id", "island"], ["t", "detector"], step,
        lambda s: [(s[0], sorted(s[1]))], ["run_id", "island", "t", "detectors"],
        f"run_id {kind}, island bigint, t double, detectors array<string>",
    ).drop("island")
    opening = groups.groupBy("run_id").agg(F.min("t").alias("first"))
    at_start = groups.join(opening, "run_id").select(
        "run_id",
        F.when((F.col("t") == F.col("first")) & (F.col("first") <= tolerance), F.lit(0.0)).otherwise(F.col("t")).alias("t"),
        F.when((F.col("t") == F.col("first")) & (F.col("first") <= tolerance), "start")
        .otherwise(transition_kind(F.col("detectors"))).alias("transition"),
        F.array_join("detectors", ",").alias("detector"),
    )
    implicit = opening.where(F.col("first") > tolerance).select(
        "run_id", F.lit(0.0).alias("t"), F.lit("start").alias("transition"), F.lit("implicit").alias("detector")
    )
    return at_start.unionByName(implicit)


def transition_kind(detectors: Column) -> Column:
    """Name a transition from the set of detectors that fired."""
    return (
        F.when(F.array_contains(detectors, "threshold"), "fade")
        .when(F.array_contains(detectors, "content"), "cut")
        .when(F.array_contains(detectors, "adaptive"), "gradual")
        .otherwise("unknown")
    )


def merge_samples(samples: DataFrame, max_gap: float, width: float | None = None) -> DataFrame:
    """Qualifying samples within ``max_gap`` of the one before form one interval."""
    grouped = islands(samples, ["run_id"], ["t"], lambda p: F.col("t") - p["t"] > max_gap, ["t"], width)
    return grouped.groupBy("run_id", "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("samples"),
        F.sum("value").alias("total"),
    )


def merge_windows(
    windows: DataFrame, durations: DataFrame, threshold: float, width: float | None = None
) -> DataFrame:
    """Overlapping windows of one label above the threshold become one event at its peak."""
    hot = windows.where(F.col("probability") >= threshold)
    grouped = islands(
        hot, ["run_id", "label"], ["start_t", "idx"], lambda p: F.col("start_t") > p["end_t"], ["end_t"], width
    )
    best = F.struct("probability", -F.col("start_t"), -F.col("idx"))
    return (
        grouped.groupBy("run_id", "label", "island")
        .agg(
            F.min("start_t").alias("start_t"),
            F.max("end_t").alias("_end"),
            F.max_by((F.col("start_t") + F.col("end_t")) / 2, best).alias("_mid"),
            F.max("probability").alias("confidence"),
            F.count(F.lit(1)).alias("windows"),
        )
        .join(durations, "run_id")
        .select(
            "run_id", "label", "start_t", F.least("duration", "_end").alias("end_t"),
            F.least("duration", "_mid").alias("peak_t"), "confidence", "windows",
        )
    )


def covering_maximum(
    grid: DataFrame, windows: DataFrame, bucket: float, width: float | None = None
) -> DataFrame:
    """Largest probability of the windows over each grid time; nearest window if none covers it."""
    inside = (
        stab_join(grid, windows.select("run_id", "start_t", "end_t", "probability"), ["run_id"], "t",
                  ("start_t", "end_t"), bucket)
        .groupBy("run_id", "t").agg(F.max("probability").alias("covered"))
    )
    middles = windows.select("run_id", ((F.col("start_t") + F.col("end_t")) / 2).alias("mid"), "probability")
    near = asof(grid.withColumnRenamed("t", "gt"), middles, ["run_id"], "gt", "mid", ["mid", "probability"], width)
    left_gap, right_gap = F.col("gt") - F.col("lo.mid"), F.col("hi.mid") - F.col("gt")
    nearest = F.when(
        F.col("hi").isNull() | (left_gap <= right_gap), F.col("lo.probability")
    ).otherwise(F.col("hi.probability"))
    return near.select("run_id", F.col("gt").alias("t"), nearest.alias("near")).join(
        inside, ["run_id", "t"], "left"
    ).select("run_id", "t", F.coalesce("covered", "near").alias("probability"))


def group_scenes(
    shots: DataFrame, similarity: float, cap: float, width: float | None = None
) -> DataFrame:
    """Shots to scenes: split above ``cap`` seconds, else join when similar or bridged by speech.

    ``shots`` has ``start_t, end_t, similar`` (to the shot before) and ``bridged``. A shot
    that is neither similar nor bridged always opens a scene, so a run is cut there.
    """
    cut = islands(
        shots, ["run_id"], ["start_t"],
        lambda p: ~((F.coalesce("similar", F.lit(0.0)) >= similarity) | F.col("bridged")), ["start_t"], width,
    )

    def step(state, row):
        start, end = row
        if state is None:
            return (start, end, 1), []
        if end - state[0] > cap:
            return (start, end, 1), [state]
        return (state[0], end, state[2] + 1), []

    kind = shots.schema["run_id"].dataType.simpleString()
    return fold_sorted(
        cut.withColumn("island", F.col("island").cast("long")), ["run_id", "island"], ["start_t", "end_t"], step,
        lambda s: [s], ["run_id", "island", "start_t", "end_t", "shots"],
        f"run_id {kind}, island bigint, start_t double, end_t double, shots int",
    ).drop("island")


_PUNCTUATION = re.compile(r"[^a-z0-9 ]+")


def merge_texts(
    detections: DataFrame, span: float, similarity: float = 0.72, width: float | None = None
) -> DataFrame:
    """Similar on-screen texts join while their group is still open (2.5 spans).

    Keeps the text of best confidence. Groups close after the gap, so the fold holds only
    the open ones; a run is cut at every longer silence.
    """
    gap = span * 2.5
    cut = islands(detections, ["run_id"], ["t", "idx"], lambda p: F.col("t") - p["t"] > gap, ["t"], width)

    def emit(g: dict) -> tuple:
        return (g["first"], g["last"] + span, g["text"], g["n"], g["total"] / g["n"])

    def step(state, row):
        t, _, text, confidence = row
        groups = state or []
        closed = [g for g in groups if t - g["last"] > gap]
        groups = [g for g in groups if t - g["last"] <= gap]
        key = " ".join(_PUNCTUATION.sub(" ", text.lower()).split())
        if key:
            for g in groups:
                if difflib.SequenceMatcher(None, key, g["key"]).ratio() >= similarity:
                    g["last"], g["n"], g["total"] = t, g["n"] + 1, g["total"] + confidence
                    if confidence > g["best"]:
                        g["text"], g["best"] = text, confidence
                    break
            else:
                groups.append(
                    {"key": key, "text": text, "first": t, "last": t, "best": confidence, "n": 1, "total": confidence}
                )
        return groups, [emit(g) for g in closed]

    kind = detections.schema["run_id"].dataType.simpleString()
    return fold_sorted(
        cut.withColumn("island", F.col("island").cast("long")), ["run_id", "island"],
        ["t", "idx", "text", "confidence"], step, lambda s: [emit(g) for g in (s or [])],
        ["run_id", "island", "start_t", "end_t", "text", "occurrences", "confidence"],
        f"run_id {kind}, island bigint, start_t double, end_t double, text string, occurrences int, confidence double",
    ).drop("island")


def suppress_boxes(boxes: DataFrame, keys: Sequence[str], limit: float = 0.6) -> DataFrame:
    """Within one frame and label drop a box that overlaps a kept, more confident one.

    ``boxes`` has ``x1, y1, x2, y2, confidence, idx``. A frame's boxes are few by nature
    (one detector call), so the greedy rule runs as an array fold inside the JVM.
    """
    fields = ["x1", "y1", "x2", "y2", "confidence", "idx"]
    packed = boxes.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("confidence").alias("c"), (-F.col("idx")).alias("o"),
                                    F.struct(*fields).alias("b"))), asc=False
        ).alias("s")
    )
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    def iou(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        union = area(a) + area(b) - w * h
        return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))

    ordered = F.transform("s", lambda x: x["b"])
    empty = F.filter(ordered, lambda b: F.lit(False))
    kept = F.aggregate(
        ordered, empty,
        lambda acc, b: F.when(F.forall(acc, lambda k: iou(k, b) <= limit), F.concat(acc, F.array(b))).otherwise(acc),
    )
    return packed.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.*")


def label_appearances(
    detections: DataFrame, durations: DataFrame, span: float, min_times: int = 2
) -> DataFrame:
    """First and last sight, screen time and mean confidence of labels seen at several times."""
    return (
        detections.groupBy("run_id", "label")
        .agg(
            F.min("t").alias("first_seen"),
            F.max("t").alias("last_seen"),
            F.countDistinct("t").alias("times"),
            F.count(F.lit(1)).alias("detections"),
            F.avg("confidence").alias("mean_confidence"),
        )
        .where(F.col("times") >= min_times)
        .join(durations, "run_id")
        .select(
            "run_id", "label", "first_seen", "last_seen",
            F.least("duration", F.col("times") * span).alias("screen_seconds"), "detections", "mean_confidence",
        )
    )


def structural_markers(
    scenes: DataFrame, appearances: DataFrame, durations: DataFrame, labels: Sequence[str] = PRODUCT_LABELS,
    minimum: float = MIN_REVEAL_SECONDS,
) -> DataFrame:
    """Opening scene, and the first sustained appearance of a product label."""
    hook = scenes.groupBy("run_id").agg(F.min_by(F.struct("start_t", "end_t"), F.struct("start_t", "end_t")).alias("s")).select(
        "run_id", F.lit("hook").alias("event_type"), "s.start_t", "s.end_t", F.lit(None).cast("string").alias("label")
    )
    reveal = (
        appearances.where(F.col("label").isin(list(labels)) & (F.col("last_seen") - F.col("first_seen") >= minimum))
        .groupBy("run_id")
        .agg(F.min_by(F.struct("first_seen", "last_seen", "label"), F.struct("first_seen", "label")).alias("a"))
        .select(
            "run_id", F.lit("product_reveal").alias("event_type"), F.col("a.first_seen").alias("start_t"),
            F.col("a.last_seen").alias("end_t"), F.col("a.label").alias("label"),
        )
    )
    both = hook.unionByName(reveal).join(durations, "run_id")
    ended = both.withColumn("end_t", F.least("end_t", "duration")).drop("duration")
    return ended.where(F.col("end_t") > F.col("start_t"))


SAMPLES_A_ROW = 4096


GRID_ROWS = 500_000  # rows of one part of the grid's layout


def sample_times(durations: DataFrame, rate: float) -> DataFrame:
    """Evenly spaced mid-sample times ``(i + 0.5) / rate`` up to each run's duration."""
    count = F.greatest(F.lit(1), F.ceil(F.col("duration") * rate).cast("int"))
    # In two steps, so that no row holds a list that grows with the run.
    parts = durations.select("run_id", "duration", count.alias("_n"), F.explode(F.sequence(F.lit(0), count - 1, F.lit(SAMPLES_A_ROW))).alias("_from"))
    last = F.least(F.col("_from") + F.lit(SAMPLES_A_ROW - 1), F.col("_n") - 1)
    steps = parts.select("run_id", "duration", F.explode(F.sequence("_from", last)).alias("step"))
    t = F.least((F.col("step") + 0.5) / F.lit(rate), F.col("duration"))
    return steps.select("run_id", "step", t.alias("t"))


def feature_grid(
    durations: DataFrame,
    rate: float,
    signals: Mapping[str, tuple[DataFrame, Sequence[str]]],
    spans: DataFrame,
    states: Sequence[str],
    cuts: DataFrame,
    width: float | None = None,
) -> DataFrame:
    """Everything known about a run on a uniform grid, one row a step, in one sweep.

    ``signals`` maps a group to ``(run_id, t, columns)``: columns are interpolated, held beyond
    their ends, 0 where the run has none, null where a bracketing sample is; ``<group>_available``
    is 1 between the first and last sample. ``spans`` is a contiguous timeline whose ``states``
    (numbers) hold from ``span_start`` on, never interpolated; ``content_event_available`` tells
    whether a span holds the step. ``cuts`` (run_id, t) are impulses in ``shot_change`` at the
    nearest step. Rows without a time count for nothing; runs without length have no rows.

    Grid, samples, span starts and cuts are one union; the last row of each kind before a step
    and the first sample after it come from two running passes over the same layout, which has
    a part for about ``GRID_ROWS`` rows, so that no task sorts more as the tables grow.
    """
    runs = durations.where("duration > 0")
    spans = durable(spans)
    grid = sample_times(runs, rate).select("run_id", F.col("t").alias("_t"), F.lit(1).alias("_tag"), F.lit(0).alias("_rtag"), F.col("step").alias("_step"))
    before = [F.lit(0).alias("_tag"), F.lit(1).alias("_rtag")]
    rows = grid
    for group, (frame, names) in signals.items():
        sample = F.struct(F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in names])
        part = frame.where("t IS NOT NULL").select("run_id", F.col("t").cast("double").alias("_t"), *before, sample.alias(f"_s_{group}"))
        rows = rows.unionByName(part, allowMissingColumns=True)
    held = F.struct("span_end", *states)
    part = spans.where("span_start IS NOT NULL").select("run_id", F.col("span_start").cast("double").alias("_t"), *before, held.alias("_span"))
    rows = rows.unionByName(part, allowMissingColumns=True)
    last = F.greatest(F.lit(1), F.ceil(F.col("duration") * rate).cast("int")) - 1
    step = F.least(F.greatest(F.rint(F.col("t") * rate - 0.5).cast("int"), F.lit(0)), last)
    at = F.least((F.col("_cut") + 0.5) / F.lit(rate), F.col("duration"))
    part = cuts.where("t IS NOT NULL").join(runs, "run_id").withColumn("_cut", step).select("run_id", at.alias("_t"), *before, "_cut")
    rows = rows.unionByName(part, allowMissingColumns=True)

    if width is None:  # else the passes cut chunks of rows themselves
        steps = runs.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("duration") * rate)))).first()[0] or 0
        total = int(steps) + spans.count() + cuts.count() + sum(frame.count() for frame, _ in signals.values())
        rows = rows.repartition(max(1, -(-total // GRID_ROWS)), "run_id")
    back = {f"_lo_{g}": ("last", f"_s_{g}") for g in signals} | {"_at": ("last", "_span"), "_hit": ("last", "_cut")}
    rows = running(rows, ["run_id"], ["_t", "_tag"], back, width)
    rows = running(rows, ["run_id"], ["_t", "_rtag"], {f"_hi_{g}": ("last", f"_s_{g}") for g in signals}, width, reverse=True)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    out: list[Column] = []
    for group, (_, names) in signals.items():
        lo, hi = F.col(f"_lo_{group}"), F.col(f"_hi_{group}")
        gap = hi["t"] - lo["t"]
        w = (F.col("_t") - lo["t"]) / F.when(gap != 0, gap)
        for c in names:
            inside = F.when(gap == 0, lo[c]).otherwise(lo[c] * (1 - w) + hi[c] * w)
            value = F.when(lo.isNotNull() & hi.isNotNull(), inside).when(lo.isNotNull(), lo[c]).when(hi.isNotNull(), hi[c])
            out.append(value.otherwise(0.0).alias(c))
        out.append(flag(lo.isNotNull() & hi.isNotNull()).alias(f"{group}_available"))
    inside = F.coalesce(F.col("_t") <= F.col("_at.span_end"), F.lit(False))
    out += [F.when(inside, F.col(f"_at.{c}").cast("double")).otherwise(0.0).alias(c) for c in states]
    out += [flag(inside).alias("content_event_available"), flag(F.coalesce(F.col("_hit") == F.col("_step"), F.lit(False))).alias("shot_change")]
    return rows.where("_tag = 1").select("run_id", F.col("_step").alias("step"), *out)


def frame_label(music: Column, speech: Column, singing: Column, silence: Column, threshold: float) -> Column:
    """Silence / speech / music / other from class probabilities; song is not speech."""
    spoken = (speech >= threshold) & (speech >= 1.2 * singing)
    return (
        F.when((silence >= threshold) & (music < threshold) & ~spoken, "silence")
        .when(spoken & (speech >= music), "speech")
        .when((music >= threshold) | (singing >= threshold), "music")
        .when(spoken, "speech")
        .otherwise("other")
    )


def entropy_bits(df: DataFrame, keys: Sequence[str], value: str, bins: int = 64) -> DataFrame:
    """Shannon entropy (bits) of a histogram of values on [0, 1]."""
    bin_id = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    counts = df.where(F.col(value).between(0.0, 1.0)).groupBy(*keys, bin_id.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    # H = log2(N) - sum(c log2 c) / N needs no second pass for the total.
    total = F.sum("_c")
    h = F.log2(total) - F.sum(F.col("_c") * F.log2(F.col("_c"))) / total
    return counts.groupBy(*keys).agg(h.alias("entropy"))


def mean_label_vectors(shots: DataFrame, attributes: DataFrame, bucket: float) -> DataFrame:
    """Mean score per label over a shot's key frames; a label absent from a frame counts 0.

    ``attributes`` has ``run_id, t, label, score``; frames per shot divide the label sums, so
    absent labels need no rows.
    """
    placed = stab_join(attributes, shots, ["run_id"], "t", ("start_t", "end_t"), bucket)
    frames = placed.groupBy("run_id", "start_t").agg(F.countDistinct("t").alias("_frames"))
    sums = placed.groupBy("run_id", "start_t", "label").agg(F.sum("score").alias("_s"))
    return sums.join(frames, ["run_id", "start_t"]).select(
        "run_id", "start_t", "label", safe_div(F.col("_s"), F.col("_frames")).alias("score")
    )
