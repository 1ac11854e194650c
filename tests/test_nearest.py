"""Nearest distances: copies, missing vectors and small distances."""

import math

from pyspark.sql import functions as F

from tidemark.operators.vectors import nearest_distance


def test_copies_are_compared_once(spark):
    n = 4_000_000  # copies of 8 and of 5 vectors: 16 million million pairs of rows
    asked = spark.range(n, numPartitions=8).select("id", F.array((F.col("id") % 8).cast("double"), F.lit(0.0)).alias("v"))
    known = spark.range(n, numPartitions=8).select(F.array((F.col("id") % 5 * 2).cast("double"), F.lit(1.0)).alias("v"))
    got = nearest_distance(asked, known, "id", "v").groupBy((F.col("id") % 8).alias("k")).agg(F.min("distance"), F.max("distance"), F.count("*")).collect()
    for k, low, high, rows in got:
        assert rows == n // 8 and low == high == (1.0 if k % 2 == 0 else math.sqrt(2.0))


def test_missing_vector_keeps_its_row_and_small_distances_their_digits(spark):
    asked = spark.createDataFrame([(1, [1000.0, 1.0]), (2, None), (3, [5.0, 5.0])], "id long, v array<double>")
    known = spark.createDataFrame([([1000.0, 1.0 + 1e-7],), ([5.0, 5.0],), (None,)], "v array<double>")
    got = {x["id"]: x["distance"] for x in nearest_distance(asked, known, "id", "v").collect()}
    assert got[2] is None and got[3] == 0.0 and abs(got[1] - 1e-7) < 1e-15
