"""Finished generations of a search are one part, whatever their number."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versions import SearchStore


def _tables(rows):
    return rows, rows.select("search_id", "generation"), rows.groupBy("search_id", "generation").agg(F.count("*").alias("n"))


def test_many_generations_are_one_commit(spark, tmp_path):
    store = SearchStore(spark, str(tmp_path))
    rows = spark.range(3000).select((F.col("id") % 2).alias("search_id"), F.floor(F.col("id") / 10).cast("int").alias("generation"))
    store.write_generations(*_tables(rows.where("generation < 299")))
    store.write_generation(299, *_tables(rows.where("generation = 299")), commit=False)
    assert store.commits().count() == 1
    assert {(x["search_id"], x["generation"], x["n"]) for x in store.current_states().collect()} == {(0, 298, 5), (1, 298, 5)}
    assert store.read("evaluations").count() == 2990
    with pytest.raises(FileExistsError):
        store.write_generations(*_tables(rows.where("generation = 7")))
    store.commit("g000299", 299)
    assert {x["generation"] for x in store.current_states().collect()} == {299}
