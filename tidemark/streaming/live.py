"""Structured Streaming forms of two batch rules, on the same definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge_samples(samples: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Gap merge as session windows: ``run_id, ts, value`` with a watermark for late rows.

    A session ends ``gap`` after its last sample, so ``end_time`` is that sample's time plus
    the gap. Partial aggregates merge per session; no run is gathered.
    """
    return (
        samples.withWatermark("ts", lateness)
        .groupBy("run_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"))
        .select("run_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "samples", "total")
    )


def best_so_far(evaluations: DataFrame) -> DataFrame:
    """New bests per search as they arrive; the state is one number and one id.

    ``evaluations`` is ``search_id string, candidate_id bigint, sequence bigint, fitness
    double``. Rows of a batch are taken in sequence order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, holder = state.get if state.exists else (None, None)
        found = []
        for pdf in batches:
            for row in pdf.sort_values("sequence").itertuples(index=False):
                if pd.notna(row.fitness) and (best is None or row.fitness > best):
                    best, holder = float(row.fitness), int(row.candidate_id)
                    found.append((key[0], int(row.sequence), holder, best))
        if best is not None:
            state.update((best, holder))
        yield pd.DataFrame(found, columns=["search_id", "sequence", "best_id", "best_fitness"])

    return evaluations.groupBy("search_id").applyInPandasWithState(
        step, "search_id string, sequence bigint, best_id bigint, best_fitness double", "best double, holder bigint", "append",
        GroupStateTimeout.NoTimeout,
    )
