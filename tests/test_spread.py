"""Narrow tables of many rows lie in one split of a file; their work does not stay in one task."""

from pyspark.sql import functions as F

from tidemark.operators.vectors import nearest_other
from tidemark.plans.candidate_queries import evaluations


def test_evaluations_of_one_file_use_many_tasks(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(250_000, numPartitions=1).select(
        i.alias("p_partkey"), F.lit("t").alias("p_type"), (i % 50 + 1).cast("int").alias("p_size"), (F.lit(900.0) + i % 100).alias("p_retailprice"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() == 1
    got = evaluations(spark, str(tmp_path))
    sizes = [n for _, n in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 250_000 and max(sizes) < 100_000


def test_vectors_meet_in_bounded_groups(spark):
    rows = spark.createDataFrame([(i % 2, i, i % 3, [float(i), 1.0, 0.0]) for i in range(12)], "grp int, vec_id int, label int, v array<float>")
    found = nearest_other(rows, "grp", "vec_id", "v", "label")
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "ArrowEvalPython" not in plan  # no lists of vectors by the thousand in one batch
    got = {x["vec_id"]: x["other_distance"] for x in found.collect()}
    unit = lambda i: [x / (i * i + 1.0) ** 0.5 for x in (float(i), 1.0)]
    for i in range(12):
        others = [j for j in range(12) if j % 2 == i % 2 and j % 3 != i % 3]
        want = min(1.0 - sum(a * b for a, b in zip(unit(i), unit(j))) for j in others)
        assert abs(got[i] - want) < 1e-12
