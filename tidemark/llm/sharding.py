"""Shards of near-equal size by sampled splitters.

Records are ordered by a 64-bit key of their text, so equal texts lie together. A size-weighted
sample of the keys gives quantile boundaries of many ranges; the exact sizes of the ranges are
then measured, and an overfull range is subdivided: by further key quantiles, and a single key
that has more than a shard's share of the bytes or of the rows by hashed ids. Ranges are dealt to the shards, largest first.
Only ids, sizes and keys are moved; the texts are read once and stay where they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch

RANGES_PER_SHARD = 64
DRAWS_PER_RANGE = 16
OVERFULL = 4  # times the aimed size of a range
SPLIT_KEYS = 8  # sub-ranges of an overfull range, beside its large keys


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("key"),
    )


def sampled_splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Range boundaries: quantiles of keys that are drawn in proportion to their size.

    About ``ranges * DRAWS_PER_RANGE`` keys reach the driver, whatever the table's size.
    """
    chance = F.least(F.lit(1.0), F.col("size") * (ranges * DRAWS_PER_RANGE / max(total, 1)))
    draw = F.xxhash64("doc_id", "key", F.lit(13)) / 2.0**64 + 0.5
    keys = np.sort(rows.where(draw < chance).select("key").toPandas()["key"].to_numpy(dtype=np.int64))
    return np.unique(keys[DRAWS_PER_RANGE::DRAWS_PER_RANGE])


def _in_ranges(splitters: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(range=np.searchsorted(splitters, pdf["key"].to_numpy(), side="right").astype(np.int32))

    return run


def dealt(sizes: dict, shards: int) -> dict:
    """Shard of each range: the largest first, each to the shard that is least full."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        full, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (full + size, shard))
    return out


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Law ``bytes``: the shards' sizes are near equal. Rows of one text share a shard unless the
    text with its copies has more than a shard's share of the bytes or of the rows (null texts
    may); those copies are spread by a hash of their ids. ``slot`` counts a shard's rows from 0, by range, key and doc_id. A null
    text has size 8 and counts as empty. Ties and repeated rows get slots of their own in an
    order that only they could exchange. An empty table gives no rows. ``docs`` needs doc_id and
    text; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.store(keyed(docs))
    every = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, n_rows = every["bytes"] or 0, every["n"]
    ranges = shards * RANGES_PER_SHARD
    aim = max(total / ranges, 1.0)
    rows = rows.mapInPandas(_in_ranges(sampled_splitters(rows, total, ranges)), "doc_id long, size long, text_crc32 long, key long, range int")
    # Keys with their sizes; a hot key is one row here.
    keys = rows.groupBy("range", "key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    hot = (F.col("bytes") * shards > total) | (F.col("n") * shards > n_rows)
    pieces = F.ceil(F.greatest(F.col("bytes") / aim, F.col("n") * (ranges / max(n_rows, 1))))
    full = keys.groupBy("range").agg(F.sum("bytes").alias("all"), F.max(hot).alias("hot")).where((F.col("all") > OVERFULL * aim) | F.col("hot"))
    inside = keys.join(full.select("range"), "range")
    large = inside.where((F.col("bytes") > aim) | hot).select("range", "key", F.when(hot, pieces).otherwise(1).cast("int").alias("pieces"))
    cuts = inside.where((F.col("bytes") <= aim) & ~hot).groupBy("range").agg(F.percentile_approx("key", [i / SPLIT_KEYS for i in range(1, SPLIT_KEYS)], 1000).alias("cuts"))
    # Large keys exceed the aimed size and cuts are a row for each range: at most ``ranges`` rows each.
    placed = rows.join(F.broadcast(large), ["range", "key"], "left").join(F.broadcast(cuts), "range", "left").select(
        "doc_id", "size", "text_crc32", "key", "range",
        F.when(F.col("pieces").isNotNull(), F.col("key")).alias("own_key"),
        F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
        .otherwise(F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("key"))), F.lit(0))).alias("piece"),
    )
    placed = scratch.store(placed.withColumn("own_key", F.coalesce("own_key", F.lit(0)).cast("long")))
    by = ["range", "own_key", "piece"]
    sizes = {(r["range"], r["own_key"], r["piece"]): (r["bytes"], r["n"]) for r in placed.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    shard_of = dealt({k: b for k, (b, _) in sizes.items()}, shards)
    used = [0] * shards
    table = []
    for k in sorted(sizes):
        s = shard_of[k]
        table.append((*k, s, used[s]))
        used[s] += sizes[k][1]
    ranks = docs.sparkSession.createDataFrame(table, "range int, own_key long, piece int, shard int, first long")
    within = F.row_number().over(Window.partitionBy(*by).orderBy("key", "doc_id", "size")) - 1
    out = placed.withColumn("_at", within).join(F.broadcast(ranks), by)  # a row for each range: bounded by shards
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("_at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
