"""Column builders shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, so SQL aggregates skip them per cell."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ratio(top: Column | str, bottom: Column | str, floor: float = 1e-9) -> Column:
    """Guarded ratio: NULL when the denominator is near zero."""
    return F.when(F.abs(col(bottom)) > floor, col(top) / col(bottom))


def safe_div(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero folded into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def epoch(ts: Column | str) -> Column:
    """Seconds since 1970 as double, independent of the session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, col(ts).cast("timestamp_ntz")) / F.lit(1e6)


def month_index(ts: Column | str, first_year: int) -> Column:
    return ((F.year(col(ts)) - first_year) * 12 + F.month(col(ts)) - 1).cast("int")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from moment sums; NULL below two points or without variance.

    The built-in ``corr`` raises on a constant series under ANSI mode.
    """
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    ok = (n >= 2) & (vx > 1e-9 * n * sxx) & (vy > 1e-9 * n * syy)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / F.sqrt(vx * vy))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; positions where either is NULL are left out."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    both = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    zero = F.lit(0.0)
    dot = F.aggregate(both, zero, lambda acc, p: acc + p["x"] * p["y"])
    na = F.aggregate(both, zero, lambda acc, p: acc + p["x"] * p["x"])
    nb = F.aggregate(both, zero, lambda acc, p: acc + p["y"] * p["y"])
    return F.when((na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb)))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def stable_id(*parts: Column, length: int = 16) -> Column:
    """Short sha256 identity of ordered parts."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


# Margins at which a label choice is abstained from and fully trusted.
MARGIN_ABSTAIN, MARGIN_CONFIDENT = 0.018, 0.060


def margin_confidence(margin: Column | str) -> Column:
    """Score margin mapped linearly to [0, 1] between the two fixed margins."""
    m = col(margin)
    scaled = F.least(F.lit(1.0), (m - MARGIN_ABSTAIN) / (MARGIN_CONFIDENT - MARGIN_ABSTAIN))
    return F.when(m <= MARGIN_ABSTAIN, F.lit(0.0)).otherwise(F.round(scaled, 4))


def directional(direction: Column, value: Column, target: Column) -> Column:
    """Fold maximise / minimise / target into "higher is better"."""
    return (
        F.when(direction == "maximize", value)
        .when(direction == "minimize", -value)
        .when(direction == "target", -F.abs(value - target))
    )


def display_normalise(value: Column, low: Column, high: Column) -> Column:
    return F.when(high - low <= 0, F.lit(0.5)).otherwise(clip((value - low) / (high - low), 0.0, 1.0))


def signed_normalise(value: Column, extent: Column) -> Column:
    return F.when(extent <= 0, F.lit(0.0)).otherwise(clip(value / extent, -1.0, 1.0))
