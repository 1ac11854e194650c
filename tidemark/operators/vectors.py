"""Vector operators: exemplar classes, streamed clustering, separation, nearest distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import cosine
from tidemark.operators.sequence import fold_sorted
from tidemark.session import durable

BLOCK = 512
MEETING = 4096  # vectors of either side of a meeting
MEASURED = 65_536  # pairs measured again at a time
# Cluster distance threshold and the separation below which labels are withheld.
DISTANCE_THRESHOLD, MIN_SEPARATION = 0.55, 0.10


def class_scores(vectors: DataFrame, exemplars: DataFrame, vec: str, label: str) -> DataFrame:
    """Best cosine to the exemplars of each class, as ``scores map<class, double>``.

    Exemplars are a declared rule set (one row of arrays joined on a constant key).
    """
    packed = exemplars.select(
        F.lit(0).alias("_k"), F.struct(F.col(label).cast("string").alias("c"), F.col(vec).alias("v")).alias("e")
    ).groupBy("_k").agg(F.collect_list("e").alias("_ex"))
    scored = vectors.withColumn("_k", F.lit(0)).join(packed, "_k").withColumn(
        "_s", F.transform("_ex", lambda e: F.struct(e["c"].alias("c"), cosine(F.col(vec), e["v"]).alias("s")))
    )
    classes = F.array_distinct(F.transform("_s", lambda e: e["c"]))
    best = F.map_from_arrays(
        classes,
        F.transform(classes, lambda c: F.array_max(F.transform(F.filter("_s", lambda e: e["c"] == c), lambda e: e["s"]))),
    )
    return scored.withColumn("scores", best).drop("_k", "_ex", "_s")


def best_class(scores: Column, floor: float) -> Column:
    """Class of the best score, ``unknown`` below the floor; struct (label, score)."""
    top = F.array_max(
        F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("label")))
    )
    label = F.when(top["score"] < floor, "unknown").otherwise(top["label"])
    return F.struct(label.alias("label"), top["score"].alias("score"))


def cluster_in_order(
    vectors: DataFrame, group: str, order: str, vec: str, threshold: float = DISTANCE_THRESHOLD
) -> DataFrame:
    """Assign each vector, in order, to the first running centroid within the threshold.

    The rule depends on order, so a group is one streamed fold; it holds its centroids only,
    never the group's vectors.
    """

    def step(state, row):
        index, raw = row
        v = np.asarray(raw, dtype=float)
        norm = np.linalg.norm(v)
        v = v / norm if norm else v
        centroids = state if state is not None else []
        for i, c in enumerate(centroids):
            if 1.0 - float(v @ c) <= threshold:
                merged = c + v
                centroids[i] = merged / np.linalg.norm(merged)
                return centroids, [(index, i)]
        centroids.append(v)
        return centroids, [(index, len(centroids) - 1)]

    kind = vectors.schema[group].dataType.simpleString()
    return fold_sorted(
        vectors, [group], [order, vec], step, lambda s: [], [group, order, "cluster"],
        f"{group} {kind}, {order} {vectors.schema[order].dataType.simpleString()}, cluster int",
    )


def nearest_other(vectors: DataFrame, group: str, id_col: str, vec: str, cluster: str) -> DataFrame:
    """Per vector: mean cosine distance to its own cluster (others only) and to the nearest
    vector of another cluster.

    The mean needs only the cluster's vector sum. The minimum compares bounded parts by matrix
    product; two parts emit one number per vector, never a row per pair.
    """
    unit = vectors.select(
        group, id_col, cluster,
        F.transform(vec, lambda x: x.cast("double")).alias("_v"),
    )
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    unit = unit.withColumn("_n", norm).withColumn(
        "_v", F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))
    ).drop("_n")
    sums = (
        unit.select(group, cluster, F.posexplode("_v").alias("i", "x"))
        .groupBy(group, cluster, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
        .groupBy(group, cluster)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("_sum"), F.max("n").alias("_size"))
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    own = unit.join(sums, [group, cluster]).select(
        group, id_col, cluster,
        F.when(F.col("_size") > 1, 1 - (dot(F.col("_v"), F.col("_sum")) - dot(F.col("_v"), F.col("_v"))) / (F.col("_size") - 1)).alias("same_distance"),
    )
    # Either side of a group is dealt to parts of about MEETING rows; every two parts meet in one task.
    sizes = unit.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("_parts"))
    parts = unit.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    left = parts.withColumn("_l", F.col("_own")).withColumn("_r", every).select(group, "_l", "_r", id_col, cluster, "_v")
    right = parts.withColumn("_r", F.col("_own")).withColumn("_l", every)
    right = right.select(*[F.col(c).alias(f"_other{c}") for c in (group, "_l", "_r")], F.col(cluster).alias("_cluster"), F.col("_v").alias("_w"))

    def nearest(ls: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if ls.empty or rs.empty:
            return ls[[group, id_col]].assign(d=0.0).iloc[:0]
        lv, rv = np.stack(ls["_v"].to_numpy()), np.stack(rs["_w"].to_numpy())
        codes, _ = pd.factorize(pd.concat([ls[cluster], rs["_cluster"]], ignore_index=True))
        lc, rc = codes[: len(ls)], codes[len(ls) :]
        best = np.empty(len(ls))
        for lo in range(0, len(ls), BLOCK):
            same = lc[lo : lo + BLOCK, None] == rc[None, :]
            best[lo : lo + BLOCK] = np.where(same, np.inf, 1.0 - lv[lo : lo + BLOCK] @ rv.T).min(axis=1)
        return ls[[group, id_col]].assign(d=best)[np.isfinite(best)]

    schema = left.select(group, id_col, F.lit(0.0).alias("d")).schema
    met = left.groupBy(group, "_l", "_r").cogroup(right.groupBy(*right.columns[:3])).applyInPandas(nearest, schema)
    other = met.groupBy(group, id_col).agg(F.min("d").alias("other_distance"))
    return own.join(other, [group, id_col], "left")


def separation(distances: DataFrame, group: str, cluster: str) -> DataFrame:
    """Mean of (b - a) / max(a, b) per group; 1 with one cluster or fewer than three vectors."""
    a, b = F.col("same_distance"), F.col("other_distance")
    s = F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b))
    usable = a.isNotNull() & b.isNotNull()
    return distances.groupBy(group).agg(
        F.when((F.countDistinct(cluster) < 2) | (F.count(F.lit(1)) < 3), F.lit(1.0))
        .otherwise(F.coalesce(F.avg(F.when(usable, s)), F.lit(0.0))).alias("separation"),
        F.countDistinct(cluster).alias("clusters"),
    )


def number_by_first(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """Number the labels of each group by first appearance, from 1."""
    from pyspark.sql import Window

    first = rows.groupBy(group, label).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(group).orderBy("_first")
    return first.withColumn("number", F.dense_rank().over(w)).drop("_first")


def _nearest_of(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distance of every row of ``c`` to the nearest row of ``t``.

    A matrix product finds the nearest; its distance is then taken from the differences, as the
    product alone loses the digits of small distances.
    """
    out = np.empty(len(c))
    tt = (t * t).sum(axis=1)
    for lo in range(0, len(c), BLOCK):
        part = c[lo : lo + BLOCK]
        near = tt[None, :] - 2.0 * (part @ t.T)
        # Whatever the rounding of the product cannot tell from the nearest is measured again.
        slack = 1e-13 * c.shape[1] * (1.0 + (part * part).sum(axis=1) + tt.max())
        i, j = np.nonzero(near <= (near.min(axis=1) + slack)[:, None])
        best = np.full(len(part), np.inf)
        for at in range(0, len(i), MEASURED):
            a, b = i[at : at + MEASURED], j[at : at + MEASURED]
            np.minimum.at(best, a, ((part[a] - t[b]) ** 2).sum(axis=1))
        out[lo : lo + BLOCK] = np.sqrt(best)
    return out


def nearest_distance(
    candidates: DataFrame, training: DataFrame, key: str, vec: str
) -> DataFrame:
    """Euclidean distance of every candidate to its nearest training vector; NULL without any.

    Equal vectors are compared once on either side. Bounded groups of vectors meet through an equi
    key, and a meeting yields one number for each candidate vector in it.
    """
    known = durable(training.select(F.col(vec).alias("v")).where("v IS NOT NULL").distinct())
    n = known.count()
    if n == 0:
        return candidates.select(key, F.lit(None).cast("double").alias("distance"))
    asked = candidates.select(F.col(vec).alias("v")).where("v IS NOT NULL").distinct()
    asked = durable(asked.withColumn("_id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    blocks, groups = -(-n // MEETING), max(1, -(-asked.count() // MEETING))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    right = known.withColumn("_b", F.pmod(F.xxhash64("v"), F.lit(blocks))).withColumn("_g", every(groups))
    left = asked.withColumn("_g", F.pmod(F.xxhash64("v"), F.lit(groups))).withColumn("_b", every(blocks))

    def meet(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if c.empty or t.empty:
            return pd.DataFrame({"_id": np.empty(0, dtype=np.int64), "d": np.empty(0)})
        d = _nearest_of(np.stack(c["v"].to_numpy()).astype(float), np.stack(t["v"].to_numpy()).astype(float))
        return pd.DataFrame({"_id": c["_id"], "d": d})

    met = left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInPandas(meet, "_id long, d double")
    found = asked.join(met.groupBy("_id").agg(F.min("d").alias("distance")), "_id").select("v", "distance")
    return candidates.select(key, F.col(vec).alias("v")).join(found, "v", "left").select(key, "distance")
