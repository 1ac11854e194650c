"""Exact range join of embeddings by metric partitions.

Within a label the angle between vectors is a metric. Pivots, drawn by hash in proportion to the
label's size, partition the vectors: each has its home in the cell of its nearest pivot. If two
vectors are within the radius ``r`` of each other, then by the triangle inequality the distances
of either to any pivot differ by ``r`` at most; so a vector visits every other cell whose pivot
is no more than ``2 r`` farther than its own nearest one and within ``r`` of the cell's own
radius. Cells join independently: visitors and members against the cell's members, as products
of bounded blocks in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components

COSINE = 0.98
PER_PIVOT = 2000  # vectors for each pivot, about
BLOCK = 512
SLACK = 1e-7  # of angles, against rounding: only lets more pairs be compared


def unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, dtype=np.float64)
    return v / np.sqrt(v @ v)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: labelled, not zero, all components finite."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where("label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))


def _homes(label_pivots: dict, radius: float):
    """Task: a vector's cell and the cells it may visit, by its angles to the label's pivots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for (label, width), rows in pdf.groupby(["label", "width"], sort=False):
                x = np.stack([unit(v) for v in rows["vector"]])
                angle = np.arccos(np.clip(x @ label_pivots[(label, width)].T, -1.0, 1.0))
                home = angle.argmin(axis=1)
                near = angle[np.arange(len(x)), home]
                cells, gap = [], []
                for a, d, h in zip(angle, near, home, strict=True):
                    c = np.flatnonzero(a <= d + 2 * radius + SLACK)
                    c = np.concatenate(([h], c[c != h]))
                    cells.append(c.astype(np.int32))
                    gap.append(a[c])
                parts.append(rows[["label", "width", "vid"]].assign(home=home.astype(np.int32), cells=cells, angles=gap))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["label", "width", "vid", "home", "cells", "angles"])

    return run


def _joined(least: float):
    """Rows sorted by (cell, block, asks): a block of members, then all that ask it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, asking = None, [], []
        matrix = parts = None

        def answer() -> pd.DataFrame | None:
            nonlocal matrix, parts, asking
            if not asking or not members:
                asking = []
                return None
            ids = np.array([m[0] for m in members])
            if matrix is None:
                matrix = np.stack([m[2] for m in members])
                near = matrix @ matrix.T >= least
                parts = np.arange(len(ids))
                while True:  # connected parts of the block
                    low = np.where(near, parts[None, :], len(ids)).min(axis=1)
                    low = np.minimum(low, parts)
                    if (low == parts).all():
                        break
                    parts = low
            weight = np.array([m[1] for m in members])
            own = np.array([a[0] for a in asking])
            linked = (np.stack([a[1] for a in asking]) @ matrix.T >= least) & (own[:, None] != ids[None, :])
            rows = []
            for i in np.flatnonzero(linked.any(axis=1)):
                hit = np.flatnonzero(linked[i])
                # One edge to each connected part; a member of the block gives all its edges there.
                edge = hit if own[i] in ids else hit[np.unique(parts[hit], return_index=True)[1]]
                rows.append((own[i], int(weight[hit].sum()), ids[edge[ids[edge] < own[i]]] if own[i] in ids else ids[edge]))
            asking = []
            return pd.DataFrame(rows, columns=["vid", "n", "near"]) if rows else None

        for pdf in batches:
            for label, width, cell, block, asks, vid, weight, raw in pdf.itertuples(index=False, name=None):
                if (label, width, cell, block) != key:
                    if (out := answer()) is not None:
                        yield out
                    key, members, matrix = (label, width, cell, block), [], None
                if asks:
                    asking.append((vid, unit(raw)))
                    if len(asking) >= BLOCK and (out := answer()) is not None:
                        yield out
                else:
                    members.append((vid, weight, unit(raw)))
        if (out := answer()) is not None:
            yield out

    return run


def range_components(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Links join rows with equal, non-null labels, vectors of one length and cosine >= ``least``.
    Null, zero and non-finite vectors, and rows with a null label or id, have no links and are
    their own component. Copies of a vector in a label are compared once and count each. Repeated
    ids are rows of their own that share a component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    radius = float(np.arccos(least))
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = scratch.store(usable(given).select("vec_id", "label", "embedding", F.size("embedding").alias("width"), F.xxhash64("label", "embedding").alias("same")))
    # One vector for each set of copies; its id is the smallest of theirs.
    single = rows.groupBy("label", "width", "same", "embedding").agg(F.min("vec_id").alias("vid"), F.count("*").alias("weight"))
    single = scratch.store(single.mapInPandas(_as_bytes, "label long, width int, vid long, weight long, vector binary"))
    sizes = single.groupBy("label", "width").agg(F.count("*").alias("n"))
    draw = F.xxhash64("vid", F.lit(17)) / 2.0**64 + 0.5
    drawn = single.join(sizes, ["label", "width"]).where((draw < 1.0 / PER_PIVOT) | (F.col("n") <= PER_PIVOT))
    first = F.min_by("vector", F.struct(F.xxhash64("vid", F.lit(17)), "vid"))
    small = drawn.where(F.col("n") <= PER_PIVOT).groupBy("label", "width").agg(first.alias("vector"))
    large = drawn.where(F.col("n") > PER_PIVOT).select("label", "width", "vector")
    pivots: dict = {}
    for r in small.union(large).collect():
        pivots.setdefault((r["label"], r["width"]), []).append(unit(r["vector"]))
    for r in sizes.collect():  # a large label from which no pivot was drawn
        if (r["label"], r["width"]) not in pivots:
            axis = np.zeros(r["width"])
            axis[0] = 1.0
            pivots[(r["label"], r["width"])] = [axis]
    pivots = {k: np.stack(sorted(v, key=lambda x: x.tobytes())) for k, v in pivots.items()}
    homes = scratch.store(single.mapInPandas(_homes(pivots, radius), "label long, width int, vid long, home int, cells array<int>, angles array<double>"))
    cells = homes.groupBy("label", "width", F.col("home").alias("cell")).agg(F.count("*").alias("n"), F.max(F.col("angles")[0]).alias("reach"))
    cells = cells.select("label", "width", "cell", "reach", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = homes.withColumnRenamed("home", "cell").join(cells, ["label", "width", "cell"]).select(
        "label", "width", "cell", F.pmod(F.xxhash64("vid"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "vid"
    )
    visits = homes.select("label", "width", "vid", F.explode(F.arrays_zip("cells", "angles")).alias("to")).select("label", "width", "vid", F.col("to.cells").alias("cell"), F.col("to.angles").alias("angle"))
    asks = (
        visits.join(cells, ["label", "width", "cell"]).where(F.col("angle") <= F.col("reach") + radius + SLACK)
        .select("label", "width", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "vid")
    )
    met = (
        member.union(asks).join(single.select("vid", "weight", "vector"), "vid").select("label", "width", "cell", "block", "asks", "vid", "weight", "vector")
        .repartition("label", "width", "cell", "block").sortWithinPartitions("label", "width", "cell", "block", "asks")
        .mapInPandas(_joined(least), "vid long, n long, near array<long>")
    )
    met = scratch.store(met)
    counts = met.groupBy("vid").agg(F.sum("n").alias("others"))
    found = components(met.select("vid", F.explode("near").alias("dst")), scratch, "vid", "dst")
    labels = single.select("vid", "weight").join(counts, "vid", "left").join(found.withColumnRenamed("id", "vid"), "vid", "left")
    per_row = rows.join(single_ids(rows), ["label", "width", "same"]).select("vec_id", "vid").join(labels, "vid").select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vid").alias("component_id")
    )
    per_row = per_row.groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    return given.select("vec_id").join(per_row, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def single_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "width", "same").agg(F.min("vec_id").alias("vid"))


def _as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(vector=[np.asarray(v, dtype=np.float64).tobytes() for v in pdf["embedding"]])[["label", "width", "vid", "weight", "vector"]]
