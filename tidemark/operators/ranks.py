"""Exact quantiles and ranks that hold when one group dominates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.session import durable

HOT_ROWS = 500_000
ACCURACY = 2_000


# Python has it from 3.13 on.
fma = getattr(math, "fma", None) or (lambda x, y, z: float(Fraction(x) * Fraction(y) + Fraction(z)))


@F.pandas_udf(DoubleType())
def between(low: pd.Series, high: pd.Series, weight: pd.Series) -> pd.Series:
    """``low * (1 - weight) + high * weight``, the first product fused with the sum, as DuckDB's
    ``quantile_cont`` rounds it; equal values stay as they are. One row per group."""
    return pd.Series([
        a if w == 0 or a == b else fma(a, 1 - w, b * w) if math.isfinite(a) and math.isfinite(b) else a * (1 - w) + b * w
        for a, b, w in zip(low, high, weight, strict=True)
    ], dtype="float64")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Linear-interpolation quantiles (numpy's default), one row per group.

    The two rows beside each wanted rank are taken by a window when no group exceeds
    ``hot_rows``. Otherwise a sketch brackets the rank, rows outside the bracket are only
    counted, and the few rows inside are ordered as ``(value, count)``. Spark's ``percentile``
    is not used: its last digit differs from the SQL's in many groups.
    """
    keys = list(keys)
    names = list(probs)
    if largest_group(df, keys) <= hot_rows:
        w = Window.partitionBy(*keys)
        rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
        rows = rows.withColumn("_i", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
        ranks = {n: F.lit(float(p)) * (F.col("_n") - 1) for n, p in probs.items()}
        wanted = F.lit(False)
        for rank in ranks.values():
            wanted = wanted | (F.col("_i") == F.floor(rank)) | (F.col("_i") == F.ceil(rank))
        out = []
        for n, rank in ranks.items():
            out += [
                F.max(F.when(F.col("_i") == F.floor(rank), F.col("_v"))).alias(f"_low_{n}"),
                F.max(F.when(F.col("_i") == F.ceil(rank), F.col("_v"))).alias(f"_high_{n}"),
                F.max(rank - F.floor(rank)).alias(f"_weight_{n}"),
            ]
        beside = rows.where(wanted).groupBy(*keys).agg(*out)
        return beside.select(*keys, *[between(f"_low_{n}", f"_high_{n}", f"_weight_{n}").alias(n) for n in names])
    slack = 4.0 / ACCURACY
    ask: list[float] = []
    for p in probs.values():
        ask += [max(0.0, p - slack), min(1.0, p + slack)]
    clean = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    group = keys or ["_all"]
    if not keys:
        clean = clean.withColumn("_all", F.lit(0))
    sketch = clean.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", ask, ACCURACY).alias("_q"),
    )
    # In a small group the sketch's slack is under two rows, so take all of it.
    small = F.col("_n") <= 4 * ACCURACY
    bounds = []
    for i, (name, p) in enumerate(probs.items()):
        rank = F.lit(p) * (F.col("_n") - 1)
        bounds.append(
            F.struct(
                F.lit(name).alias("name"),
                F.when(small | F.lit(ask[2 * i] == 0.0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                F.when(small | F.lit(ask[2 * i + 1] == 1.0), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
                F.floor(rank).alias("rank"),
                (rank - F.floor(rank)).alias("weight"),
            )
        )
    brackets = sketch.select(*group, F.array(*bounds).alias("_b"))
    tagged = clean.join(brackets, group).select(*group, "_v", F.explode("_b").alias("_b"))
    counted = tagged.where(F.col("_v") <= F.col("_b.hi")).groupBy(
        *group,
        F.col("_b.name").alias("_name"),
        F.col("_b.rank").alias("_rank"),
        F.col("_b.weight").alias("_weight"),
        F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_in"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group, "_name").orderBy(F.col("_in").asc_nulls_first())
    cumulative = counted.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_in")))
    high = F.min(F.when(F.col("_upto") > F.col("_rank") + 1, F.col("_in")))
    beside = cumulative.groupBy(*group, "_name").agg(low.alias("_low"), F.coalesce(high, low).alias("_high"), F.first("_weight").alias("_weight"))
    found = beside.select(*group, "_name", between("_low", "_high", "_weight").alias("_q"))
    wide = found.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names]
    )
    return wide if keys else wide.drop("_all")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group: one number on the driver."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(grouped.agg(F.max("n").alias("n")).first()["n"] or 0)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number`` within groups, for groups of any size.

    Groups at or below ``hot_rows`` use a window. Otherwise rows are range-partitioned on
    ``(keys, order)``, written once so that partition contents are fixed, numbered inside
    each partition and shifted by the counts of the partitions before it.
    """
    keys = list(keys)
    if largest_group(df, keys) <= hot_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    laid_out = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    fixed = durable(laid_out.withColumn("_part", F.spark_partition_id()))
    part = [*keys, "_part"]
    before = fixed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*part, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        fixed.withColumn("_i", inside)
        .join(before, part)
        .withColumn(name, (F.col("_i") + F.col("_offset")).cast("int"))
        .drop("_i", "_offset", "_part")
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """Best ``k`` rows of each group. Spark prunes to ``k`` per group before the shuffle
    (``WindowGroupLimit``), so a hot group sends at most ``k`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
