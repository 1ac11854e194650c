"""Pareto fronts over many points without comparing all pairs.

Local fronts prune each partition first: a point beaten inside its partition is beaten
globally, so the front survives. The few survivors are then checked against each other in
blocks that meet through an equi key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import directional
from tidemark.session import durable

BLOCK_ROWS = 5_000


def _dominates(a: str, b: str, cols: Sequence[str]) -> Column:
    at_least = reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") >= F.col(f"{b}.{c}") for c in cols])
    better = reduce(lambda x, y: x | y, [F.col(f"{a}.{c}") > F.col(f"{b}.{c}") for c in cols])
    return at_least & better


def _front_mask(points: np.ndarray) -> np.ndarray:
    """Rows of ``points`` not dominated within it; best sums first so few comparisons remain."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    front: list[int] = []
    kept = np.empty((0, points.shape[1]))
    for i in order:
        p = points[i]
        if len(front) and np.any(np.all(kept >= p, axis=1) & np.any(kept > p, axis=1)):
            continue
        front.append(int(i))
        kept = np.vstack([kept, p])
    mask = np.zeros(len(points), dtype=bool)
    mask[front] = True
    return mask


def local_fronts(points: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Front of every partition, streamed batch by batch (holds only the current front)."""
    names = list(cols)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front: pd.DataFrame | None = None
        for pdf in batches:
            pool = pdf if front is None else pd.concat([front, pdf], ignore_index=True)
            front = pool[_front_mask(pool[names].to_numpy(dtype=float))].reset_index(drop=True)
        if front is not None:
            yield front

    slim = points.select(key, *names)
    return slim.mapInPandas(prune, slim.schema)


def pareto_front(points: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``key`` and ``cols`` of the non-dominated points; points with a NULL are left out.

    Higher is better in every column. Equal points do not dominate each other.
    """
    usable = points.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols]))
    survivors = durable(local_fronts(usable, key, cols))
    blocks = max(1, -(-survivors.count() // BLOCK_ROWS))
    placed = survivors.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    # Every block meets every challenger; the block number is the join key.
    challengers = survivors.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    beaten = (F.col("a._block") == F.col("b._block")) & _dominates("a", "b", cols)
    return placed.alias("b").join(challengers.alias("a"), beaten, "left_anti").drop("_block")


def dominators(points: DataFrame, among: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """For each dominated point how many of ``among`` dominate it, and the smallest id that does.

    A count and a witness, not the list: that would hold a row for every dominated pair.
    ``among`` is spread over blocks when it is large; the block number is the join key.
    """
    blocks = max(1, -(-among.count() // BLOCK_ROWS))
    side = among.select(key, *cols).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    probes = points.select(key, *cols).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    cond = (F.col("a._block") == F.col("b._block")) & _dominates("a", "b", cols)
    hits = probes.alias("b").join(side.alias("a"), cond)
    return hits.groupBy(F.col(f"b.{key}").alias(key)).agg(
        F.count(F.lit(1)).alias("dominators"), F.min(F.col(f"a.{key}")).alias("witness")
    )


DEPTH_ROWS = 20_000  # points of one block of the front numbering


def _depths(points: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Front numbers of points in an order in which dominators come first; ``least`` is known from elsewhere."""
    depth = least.copy()
    if not least.any():  # fronts are nested here: who is beaten by one front is beaten by all before it
        fronts: list[np.ndarray] = []
        sizes: list[int] = []
        for i, p in enumerate(points):
            low, high = 0, len(fronts)
            while low < high:
                middle = (low + high) // 2
                front = fronts[middle][: sizes[middle]]
                if (np.all(front >= p, axis=1) & np.any(front > p, axis=1)).any():
                    low = middle + 1
                else:
                    high = middle
            depth[i] = low
            if low == len(fronts):
                fronts.append(np.empty((4, points.shape[1])))
                sizes.append(0)
            if sizes[low] == len(fronts[low]):
                fronts[low] = np.concatenate((fronts[low], np.empty_like(fronts[low])))
            fronts[low][sizes[low]] = p
            sizes[low] += 1
        return depth
    for i in range(1, len(points)):
        before = points[:i]
        beaten = np.all(before >= points[i], axis=1) & np.any(before > points[i], axis=1)
        if beaten.any():
            depth[i] = max(depth[i], depth[:i][beaten].max() + 1)
    return depth


def _dominance_order(points: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """Largest sum first, equal sums by the coordinates: a dominator is never after what it beats."""
    total = points[list(names)].sum(axis=1)
    return points.assign(_s=total).sort_values(["_s", *names], ascending=False, kind="stable").drop(columns="_s")


def successive_fronts(
    points: DataFrame, key: str, cols: Sequence[str], max_fronts: int | None = None, want: int | None = None, block_rows: int = DEPTH_ROWS
) -> DataFrame:
    """``key``, ``cols`` and ``front`` (from 0) of every point, or of the first fronts only.

    A point's front is the length of the longest chain of dominators above it. Points go to
    blocks by their coordinate sum, largest first, so a block depends on earlier blocks only: its
    points ask every earlier block, side by side, for the deepest dominator, and are then
    numbered in one pass, searching the fronts by bisection where that is exact. There is a round
    of jobs for each block of ``block_rows`` points, however many fronts there are. With
    ``max_fronts`` or ``want`` every partition first drops what its own points already put deeper.
    Points with a NULL are left out; ``want`` keeps whole fronts until that many points are placed.
    """
    names = list(cols)
    usable = points.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])).select(key, *names)
    schema = usable.withColumn("front", F.lit(0)).schema
    deepest = min([x for x in (max_fronts, want) if x is not None], default=None)
    if deepest is not None:

        def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = _dominance_order(pdf, names)
                yield pdf[_depths(pdf[names].to_numpy(dtype=float), np.zeros(len(pdf), dtype=np.int32)) < deepest]

        usable = usable.mapInPandas(prune, usable.schema)
    total = reduce(lambda x, y: x + y, [F.col(c).cast("double") for c in names])
    laid = durable(usable.withColumn("_sum", total))
    blocks = max(1, -(-laid.count() // block_rows))
    if blocks > 1:
        laid = laid.repartitionByRange(blocks, F.desc("_sum"), *[F.desc(c) for c in names], key)
        laid = durable(laid.withColumn("_block", F.spark_partition_id()))
    else:
        laid = laid.withColumn("_block", F.lit(0))
    numbered = laid.drop("_sum").withColumn("front", F.lit(0)).schema

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _dominance_order(pdf, names)
        return pdf.assign(front=_depths(pdf[names].to_numpy(dtype=float), pdf["front"].to_numpy(dtype=np.int32)))[numbered.names]

    def ask(done: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        known, front = done[names].to_numpy(dtype=float), done["front"].to_numpy()
        out = np.zeros(len(asking), dtype=np.int32)
        for i, p in enumerate(asking[names].to_numpy(dtype=float)):
            beaten = np.all(known >= p, axis=1) & np.any(known > p, axis=1)
            if beaten.any():
                out[i] = front[beaten].max() + 1
        return asking.assign(front=out)[numbered.names]

    placed: list[DataFrame] = []
    for block in range(blocks):
        here = laid.drop("_sum").where(F.col("_block") == block).withColumn("front", F.lit(0))
        if placed:
            earlier = reduce(DataFrame.unionByName, placed)
            asking = here.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
            answers = earlier.groupBy("_block").cogroup(asking.groupBy("_with")).applyInPandas(ask, numbered)
            same = [c for c in numbered.names if c != "front"]
            here = answers.groupBy(*same).agg(F.max("front").alias("front")).select(*numbered.names)
        found = here.groupBy("_block").applyInPandas(number, numbered)
        # Who lies below the wanted fronts is beaten by someone in the last of them, so he tells nothing more.
        found = durable(found if deepest is None else found.where(F.col("front") < deepest))
        placed.append(found)
    out = reduce(DataFrame.unionByName, placed).select(*schema.names)
    if want is not None:
        sizes = [(r["front"], r["n"]) for r in out.groupBy("front").agg(F.count("*").alias("n")).orderBy("front").collect()]
        before, last = 0, -1
        for front, n in sizes:
            if before >= want:
                break
            before, last = before + n, front
        out = out.where(F.col("front") <= last)
    return out


def take_by_front(fronts: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """Best ``n`` front by front; inside the last front by ``order`` then id (a top-n, so never a full sort)."""
    return fronts.orderBy("front", *order, key).limit(n)


def directional_vector(objectives: Sequence[tuple[str, str, float | None]]) -> Column:
    """Array of direction-folded values; NULL when any objective is missing.

    ``objectives`` lists ``(column, direction, target)``.
    """
    folded = [
        directional(F.lit(direction), F.col(c), F.lit(target).cast("double")) for c, direction, target in objectives
    ]
    known = reduce(lambda x, y: x & y, [f.isNotNull() for f in folded])
    return F.when(known, F.array(*folded))


def dominates(a: Column, b: Column) -> Column:
    """Array dominance: no component worse and one better."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x >= y).alias("ge"), (x > y).alias("gt")))
    return F.forall(pairs, lambda p: p["ge"]) & F.exists(pairs, lambda p: p["gt"])
