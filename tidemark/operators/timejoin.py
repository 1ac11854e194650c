"""Joins on irregular time: as-of family, bucketed range joins, tolerance and interpolation.

None of these plans a nested-loop join: range predicates get an equi key (the time bucket),
as-of joins are one union and one ordered pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import running


def asof(
    probes: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    probe_t: str,
    table_t: str,
    cols: Sequence[str],
    width: float | None = None,
    back: bool = True,
    ahead: bool = True,
) -> DataFrame:
    """For each probe add ``lo`` (last table row at or before) and ``hi`` (first at or after).

    Both are structs of ``cols``; null when there is no such row.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    probe_cols = [c for c in probes.columns if c not in keys]
    left = table.select(
        *keys,
        F.col(table_t).cast("double").alias("_t"),
        F.lit(0).alias("_tag"),
        F.lit(1).alias("_rtag"),
        payload.alias("_row"),
        F.lit(None).cast(probes.select(F.struct(*probe_cols).alias("s")).schema["s"].dataType).alias("_probe"),
    )
    right = probes.select(
        *keys,
        F.col(probe_t).cast("double").alias("_t"),
        F.lit(1).alias("_tag"),
        F.lit(0).alias("_rtag"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.struct(*probe_cols).alias("_probe"),
    )
    both = left.unionByName(right)
    if back:
        both = running(both, keys, ["_t", "_tag"], {"lo": ("last", "_row")}, width)
    if ahead:
        both = running(both, keys, ["_t", "_rtag"], {"hi": ("last", "_row")}, width, reverse=True)
    added = [c for c, on in (("lo", back), ("hi", ahead)) if on]
    return both.where("_tag = 1").select(*keys, "_probe.*", *added)


def nearest(
    probes: DataFrame, table: DataFrame, keys: Sequence[str], probe_t: str, table_t: str,
    cols: Sequence[str], width: float | None = None,
) -> DataFrame:
    """Nearest table row in time (struct ``hit``); a tie goes to the earlier row."""
    both = asof(probes, table, keys, probe_t, table_t, [table_t, *cols], width)
    before = F.col(probe_t) - F.col(f"lo.{table_t}")
    after = F.col(f"hi.{table_t}") - F.col(probe_t)
    pick = F.when(
        F.col("lo").isNotNull() & (F.col("hi").isNull() | (before <= after)), F.col("lo")
    ).otherwise(F.col("hi"))
    return both.withColumn("hit", pick).drop("lo", "hi")


def covering(
    probes: DataFrame, table: DataFrame, keys: Sequence[str], probe_t: str, table_t: str,
    duration: str, cols: Sequence[str], width: float | None = None,
) -> DataFrame:
    """Row whose ``[t, t + duration)`` holds the probe (struct ``hit``), else null."""
    both = asof(probes, table, keys, probe_t, table_t, [table_t, duration, *cols], width, ahead=False)
    inside = F.col(probe_t) < F.col(f"lo.{table_t}") + F.col(f"lo.{duration}")
    return both.withColumn("hit", F.when(inside, F.col("lo"))).drop("lo")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(
        F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))
    )


class BucketWidth(float):
    """Width of a time bucket, with the number of coarser levels long intervals need."""

    levels: int = 0


SPREAD = 8  # an interval touches at most SPREAD + 1 buckets of its level


def bucket_width(df: DataFrame, start: str, end: str) -> BucketWidth:
    """Twice the mean span, from one aggregate.

    Intervals longer than ``SPREAD`` buckets are filed at a coarser level (each level is
    ``SPREAD`` times wider), so one very long interval never explodes into many rows.
    """
    length = F.col(end) - F.col(start)
    facts = df.select(F.avg(length).alias("m"), F.max(length).alias("x")).first()
    width = BucketWidth(float(facts["m"]) * 2.0 if facts["m"] else 1.0)
    longest = float(facts["x"] or 0.0)
    width.levels = max(0, math.ceil(math.log(max(longest / (SPREAD * width), 1e-9), SPREAD)))
    return width


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    eps: float = 0.0,
) -> DataFrame:
    """Pairs of half-open intervals of one run that overlap by more than ``eps``.

    Two intervals overlap when one starts inside the other, so this is two stab joins that
    cannot find the same pair twice. Column names must differ except for ``keys``.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re_ = (F.col(c) for c in right_span)
    other = bucket_width(left, *left_span) if isinstance(width, BucketWidth) else width
    hit = (ls < re_ - eps) & (le > rs + eps)
    starts_inside = stab_join(left, right, keys, left_span[0], right_span, width).where(hit)
    holds_start = stab_join(right, left, keys, right_span[0], left_span, other).where(hit & (rs > ls))
    return starts_inside.unionByName(holds_start)


def stab_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    t: str,
    span: tuple[str, str],
    width: float,
    closed: bool = False,
) -> DataFrame:
    """Points with every interval ``[start, end)`` of their run that holds them."""
    s, e = F.col(span[0]), F.col(span[1])
    levels = getattr(width, "levels", 0)
    inside = (F.col(t) >= s) & ((F.col(t) <= e) if closed else (F.col(t) < e))
    if not levels:
        p = points.withColumn("_b", F.floor(F.col(t) / width).cast("long"))
        q = spans.withColumn("_b", _buckets(s, e, width))
        return p.join(q, [*keys, "_b"]).where(inside).drop("_b")
    base = float(width)
    size = lambda level: F.lit(base) * F.pow(F.lit(float(SPREAD)), level)
    needed = F.ceil(F.log(F.greatest((e - s) / (SPREAD * base), F.lit(1e-9))) / math.log(SPREAD)).cast("int")
    q = spans.withColumn("_l", F.greatest(F.lit(0), F.least(F.lit(levels), needed)))
    q = q.withColumn(
        "_b", F.explode(F.sequence(F.floor(s / size(F.col("_l"))).cast("long"), F.floor(e / size(F.col("_l"))).cast("long")))
    )
    p = points.withColumn("_l", F.explode(F.array(*[F.lit(i) for i in range(levels + 1)])))
    p = p.withColumn("_b", F.floor(F.col(t) / size(F.col("_l"))).cast("long"))
    return p.join(q, [*keys, "_l", "_b"]).where(inside).drop("_l", "_b")


def tolerance_join(
    reference: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str],
    ref_t: str,
    cand_t: str,
    tolerance: float,
    width: float | None = None,
) -> DataFrame:
    """One-to-one pairs of observations within ``tolerance`` seconds.

    Adds ``t`` (mean of the two times) and ``ambiguous``: true where either observation
    has more than one partner. ``strict_pairs`` turns ambiguity into an error.
    """
    step = float(width or max(tolerance * 4, 1e-3))
    lo, hi = F.col(cand_t) - tolerance, F.col(cand_t) + tolerance
    a = reference.withColumn("_b", F.floor(F.col(ref_t) / step).cast("long"))
    b = candidate.withColumn("_b", _buckets(lo, hi, step))
    pairs = a.join(b, [*keys, "_b"]).where((F.col(ref_t) >= lo) & (F.col(ref_t) <= hi)).drop("_b")
    left_n = pairs.groupBy(*keys, ref_t).agg(F.count(F.lit(1)).alias("_ln"))
    right_n = pairs.groupBy(*keys, cand_t).agg(F.count(F.lit(1)).alias("_rn"))
    return (
        pairs.join(left_n, [*keys, ref_t])
        .join(right_n, [*keys, cand_t])
        .withColumn("t", (F.col(ref_t) + F.col(cand_t)) / 2)
        .withColumn("ambiguous", (F.col("_ln") > 1) | (F.col("_rn") > 1))
        .drop("_ln", "_rn")
    )


def strict_pairs(pairs: DataFrame) -> DataFrame:
    """Strict mode of the tolerance join: fail the job on the first ambiguous pair."""
    guard = F.when(
        F.col("ambiguous"), F.raise_error(F.lit("timeline alignment is ambiguous")).cast("boolean")
    ).otherwise(F.lit(True))
    return pairs.where(guard).drop("ambiguous")


def interpolate(
    targets: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    target_t: str,
    table_t: str,
    value: str,
    max_gap: float | None = None,
    hold_ends: bool = False,
    width: float | None = None,
    name: str = "interpolated",
) -> DataFrame:
    """Linear interpolation of ``table.value`` at each target time.

    Exact hits are taken as observed. Never extrapolates (null) unless ``hold_ends``; a
    bracket wider than ``max_gap`` or a null endpoint gives null.
    """
    both = asof(targets, table, keys, target_t, table_t, [table_t, value], width)
    lo_t, hi_t = F.col(f"lo.{table_t}"), F.col(f"hi.{table_t}")
    lo_v, hi_v = F.col(f"lo.{value}"), F.col(f"hi.{value}")
    gap = hi_t - lo_t
    w = F.when(gap == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(target_t) - lo_t, gap))
    inside = F.when(gap == 0, lo_v).otherwise(lo_v * (1 - w) + hi_v * w)
    if max_gap is not None:
        inside = F.when(gap <= max_gap, inside)
    out = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), inside)
    if hold_ends:
        out = out.when(F.col("lo").isNull(), hi_v).otherwise(lo_v)
    return (
        both.withColumn(name, out)
        .withColumn("observed", F.col("lo").isNotNull() & F.col("hi").isNotNull() & (gap == 0))
        .drop("lo", "hi")
    )
