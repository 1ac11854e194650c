"""The grid's layout has a part for a bounded number of rows, whatever the shuffle setting."""

from pyspark.sql import functions as F

from tidemark.operators import intervals as I


def test_layout_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "GRID_ROWS", 100, raising=False)
    runs = spark.range(50).select(F.col("id").alias("run_id"), F.lit(10.0).alias("duration"))
    samples = runs.select("run_id", F.lit(2.0).alias("t"), F.col("run_id").cast("double").alias("x"))
    spans = runs.select("run_id", F.lit(0.0).alias("span_start"), F.lit(10.0).alias("span_end"), F.lit(1).alias("on"))
    cuts = runs.select("run_id", F.lit(5.0).alias("t"))
    out = I.feature_grid(runs, 1.0, {"v": (samples, ["x"])}, spans, ["on"], cuts)
    assert "hashpartitioning(run_id" in out._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    got = out.collect()
    assert len(got) == 500 and all(x["x"] == x["run_id"] and x["on"] == 1.0 for x in got) and sum(x["shot_change"] for x in got) == 50
