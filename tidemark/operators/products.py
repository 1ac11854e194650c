"""Sums over all pairs of rows of a matrix in long form, by products of dense blocks.

A matrix is cells ``(keys, row, col, value)``. Rows and columns are dealt to blocks by hash; a
task holds two row blocks against one column block and multiplies them. What leaves a task is one
line for each pair of rows, never one for each pair and column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, COLUMNS = 256, 4096  # of a block, on average
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str = "value", rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """``keys, <row>_a, <row>_b, n, sx, sy, sxx, syy, sxy`` for all pairs of rows with a <= b.

    The sums run over the columns that both rows have; a NULL value counts as there and as 0. Pairs
    without a common column are left out. A cell goes to as many tasks as its run has row blocks.
    """
    keys = list(keys)
    sizes = cells.groupBy(*keys).agg(
        F.ceil(F.approx_count_distinct(row) / rows).cast("int").alias("_rb"), F.ceil(F.approx_count_distinct(col) / columns).cast("int").alias("_cb")
    )
    slim = cells.select(*keys, F.col(row).alias("_row"), F.col(col).alias("_col"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    dealt = slim.join(sizes, keys).withColumn("_block", F.expr("cast(pmod(xxhash64(_row), _rb) as int)"))
    dealt = dealt.withColumn("_part", F.expr("cast(pmod(xxhash64(_col), _cb) as int)")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_rb") - 1)))
    dealt = dealt.select(
        *keys, F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_part", "_block", "_row", "_col", "_v"
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keys)
    kind = slim.schema["_row"].dataType.simpleString()
    schema = f"{kinds}, {row}_a {kind}, {row}_b {kind}, n double, sx double, sy double, sxx double, syy double, sxy double"

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *run, low, high, _ = key
        at_row, names = pd.factorize(pdf["_row"], sort=True)
        at_col, cols = pd.factorize(pdf["_col"])
        x, there = np.zeros((len(names), len(cols))), np.zeros((len(names), len(cols)))
        x[at_row, at_col], there[at_row, at_col] = pdf["_v"], 1.0
        block = np.zeros(len(names), dtype=np.int64)
        block[at_row] = pdf["_block"]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b, ta, tb = x[left], x[right], there[left], there[right]
        sums = {"n": ta @ tb.T, "sx": a @ tb.T, "sy": ta @ b.T, "sxx": (a * a) @ tb.T, "syy": ta @ (b * b).T, "sxy": a @ b.T}
        keep = sums["n"] > 0
        if low == high:
            keep &= left[:, None] <= right[None, :]
        i, j = np.nonzero(keep)
        swap = left[i] > right[j]  # between blocks the smaller row comes first too
        first, second = np.where(swap, right[j], left[i]), np.where(swap, left[i], right[j])
        out = {k: s[i, j] for k, s in sums.items()}
        for p, q in (("sx", "sy"), ("sxx", "syy")):
            out[p], out[q] = np.where(swap, out[q], out[p]), np.where(swap, out[p], out[q])
        names = np.asarray(names)
        return pd.DataFrame({**dict(zip(keys, run, strict=True)), f"{row}_a": names[first], f"{row}_b": names[second], **out})

    parts = dealt.groupBy(*keys, "_low", "_high", "_part").applyInPandas(multiply, schema)
    return parts.groupBy(*keys, f"{row}_a", f"{row}_b").agg(*[F.sum(s).alias(s) for s in SUMS])
