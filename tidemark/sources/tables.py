"""Readers for the star-schema tables and the panel views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch, finite, month_index

FIRST_YEAR = 1995
# A prime scale keeps means off decimal midpoints, so two engines round them alike.
PRICE_SCALE = 997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an irregular series per user: run_id, row_key, t, kind, value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("row_key"),
        epoch("ts").alias("t"),
        F.col("event_type").alias("kind"),
        finite("value").alias("value"),
    )


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a panel: run = return flag, row = ship month, unit = supplier.

    A unit has one value per month, so a (run, unit) series is bounded by the calendar.
    """
    month = month_index("l_shipdate", FIRST_YEAR)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("run_id"),
            month.alias("row_idx"),
            F.col("l_suppkey").alias("unit_id"),
        )
        .agg((F.sum("l_extendedprice") / PRICE_SCALE).alias("value"))
        .withColumn("t", F.col("row_idx").cast("double"))
    )


def unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> nation (region) -> region (network), with a hemisphere and a mask.

    Excluded units have no region, as in the reference data model.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("network")
    )
    excluded = F.col("s_acctbal") < 0
    return s.join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("unit_id"),
        F.when(~excluded, F.col("s_nationkey")).alias("region_id"),
        F.when(~excluded, F.col("network")).alias("network_id"),
        F.when(F.col("s_nationkey") < 13, "left").otherwise("right").alias("hemisphere"),
        excluded.alias("excluded"),
    )
