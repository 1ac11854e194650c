import datetime as dt

from tidemark.streaming import live


def stream(spark, tmp_path, parts, schema):
    source = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drain(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_gap_merge_sessions(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("r", at(s), 1.0) for s in (0, 1, 2, 10, 11, 100)]
    df = stream(spark, tmp_path, [rows], "run_id string, ts timestamp, value double")
    drain(live.merge_samples(df, "2 seconds", "5 seconds"), tmp_path, "sessions", "append")
    got = sorted((r.start_time.second, r.samples) for r in spark.table("sessions").collect())
    assert got == [(0, 3), (10, 2)]  # the last session is still open


def test_best_so_far_over_batches(spark, tmp_path):
    parts = [[("a", 1, 1, 2.0), ("a", 2, 2, 1.0), ("b", 9, 1, None)], [("a", 3, 3, 2.0), ("a", 4, 4, 5.0), ("b", 8, 2, -1.0)]]
    df = stream(spark, tmp_path, parts, "search_id string, candidate_id bigint, sequence bigint, fitness double")
    drain(live.best_so_far(df), tmp_path, "bests", "append")
    assert spark.table("bests").where("search_id = 'a'").selectExpr("max_by(best_id, best_fitness) AS b").first().b == 4
    assert spark.table("bests").where("search_id = 'b'").count() == 1
