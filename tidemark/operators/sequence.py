"""Ordered operators over runs that do not need a whole run in one task.

A run (one key) may hold a third of all rows, so ``Window.partitionBy(run)`` would put
that run into a single task. Here every ordered operator works on ``(run, chunk)``; a chunk
is a stretch of about equally many rows, cut by Spark's own range partitioning over
``(run, order)``, so bursts and rows of one time are split like any others. The layout is
written to the checkpoint folder, so that every reader sees the same borders; a tiny
per-chunk summary carries state across them.

``width=None`` means "no run is larger than the target": the plain window is then exact
and cheaper, and it is used as is. ``chunk_width`` makes that check. A plain number cuts
chunks of so many seconds instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

TARGET_ROWS = 250_000


class RowChunks(float):
    """A number of chunks of about equally many rows, over all runs."""


def chunk_width(
    df: DataFrame, keys: Sequence[str], t: str, target_rows: int = TARGET_ROWS
) -> RowChunks | None:
    """Chunks of about ``target_rows`` rows; ``None`` when no run is larger than that.

    One aggregate with map-side combine; two numbers reach the driver.
    """
    facts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("most"), F.sum("n").alias("all")
    ).first()
    if (facts["most"] or 0) <= target_rows:
        return None
    return RowChunks(math.ceil(facts["all"] / target_rows))


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float) -> DataFrame:
    """``df`` with ``_chunk``, increasing along each run.

    Rows that tie in ``order`` are kept apart by ``row_key`` where there is one, so a run of one
    time is cut as well.
    """
    if not isinstance(width, RowChunks):
        return df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(float(width))).cast("long"))
    ties = [c for c in ("row_key",) if c in df.columns and c not in order]
    laid_out = df.repartitionByRange(int(width), *keys, *order, *ties)
    return durable(laid_out.withColumn("_chunk", F.spark_partition_id().cast("long")))


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None = None) -> DataFrame:
    """Rows of a run together and in ``order``, so that a grouped sum of doubles adds them in that order.

    The last digit of such a sum depends on the order, and rules that compare sums (a threshold, a
    dominance) turn on it where two are equal. Runs that are cut in chunks stay as they are.
    """
    return df if width is not None else df.repartition(*keys).sortWithinPartitions(*keys, *order)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    width: float | None = None,
    lead: bool = False,
) -> DataFrame:
    """Add ``prev`` (and ``next``): structs of ``cols`` from the adjacent rows of the run."""
    payload = F.struct(*[F.col(c) for c in cols])
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn("prev", F.lag(payload).over(w))
        return out.withColumn("next", F.lead(payload).over(w)) if lead else out
    base = _chunked(df, keys, order, width)
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    inner = base.withColumn("_p", F.lag(payload).over(w))
    if lead:
        inner = inner.withColumn("_n", F.lead(payload).over(w))
    edges = base.groupBy(*part).agg(
        F.max_by(payload, _order_key(order)).alias("_last"),
        F.min_by(payload, _order_key(order)).alias("_first"),
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *part,
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    out = inner.join(edges, part, "left").withColumn("prev", F.coalesce("_p", "_before"))
    if lead:
        out = out.withColumn("next", F.coalesce("_n", "_after")).drop("_n")
    return out.drop("_p", "_before", "_after", "_chunk")


_RUNNING: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "count": (F.count, lambda carry, here: F.coalesce(carry, F.lit(0)) + here),
    "max": (F.max, lambda carry, here: F.greatest(carry, here)),
    "min": (F.min, lambda carry, here: F.least(carry, here)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, str]],
    width: float | None = None,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Cumulative ``sum/count/max/min/last`` along each run, from its start to this row.

    ``specs`` maps an output name to ``(kind, column)``. ``last`` skips nulls. With
    ``reverse`` the run is walked backwards (``last`` then means "next non-null").
    ``exclusive`` stops at the row before this one.
    """
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    stop = -1 if exclusive else Window.currentRow

    def over(parts: Sequence[str], by: Sequence[str], end: int) -> Window:
        return (
            Window.partitionBy(*parts)
            .orderBy(*[direction(c) for c in by])
            .rowsBetween(Window.unboundedPreceding, end)
        )

    def fold(kind: str, col: Column) -> Column:
        return F.last(col, ignorenulls=True) if kind == "last" else _RUNNING[kind][0](col)

    if width is None:
        w = over(keys, order, stop)
        return df.select(
            "*", *[fold(kind, F.col(c)).over(w).alias(name) for name, (kind, c) in specs.items()]
        )
    base = _chunked(df, keys, order, width)
    part = [*keys, "_chunk"]
    w = over(part, order, stop)
    inner = base.select(
        "*", *[fold(k, F.col(c)).over(w).alias(f"_r_{n}") for n, (k, c) in specs.items()]
    )
    totals = []
    for name, (kind, c) in specs.items():
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            totals.append(
                pick(F.col(c), F.when(F.col(c).isNotNull(), _order_key(order))).alias(f"_t_{name}")
            )
        else:
            totals.append(_RUNNING[kind][0](F.col(c)).alias(f"_t_{name}"))
    across = over(keys, ["_chunk"], -1)
    carry = base.groupBy(*part).agg(*totals)
    carry = carry.select(
        *part,
        *[
            (F.sum(f"_t_{n}") if k == "count" else fold(k, F.col(f"_t_{n}")))
            .over(across)
            .alias(f"_c_{n}")
            for n, (k, _) in specs.items()
        ],
    )
    out = inner.join(carry, part, "left")
    for name, (kind, _) in specs.items():
        here, before = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        merged = F.coalesce(here, before) if kind == "last" else _RUNNING[kind][1](before, here)
        out = out.withColumn(name, merged)
    return out.drop("_chunk", *[f"_r_{n}" for n in specs], *[f"_c_{n}" for n in specs])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Callable[[Column], Column],
    cols: Sequence[str],
    width: float | None = None,
    name: str = "island",
) -> DataFrame:
    """Number maximal groups of consecutive rows; ``starts(prev)`` says a new one begins."""
    flagged = neighbours(df, keys, order, cols, width)
    flagged = flagged.withColumn(
        "_new", F.when(F.col("prev").isNull() | starts(F.col("prev")), 1).otherwise(0)
    ).drop("prev")
    return running(flagged, keys, order, {name: ("sum", "_new")}, width).drop("_new")


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, width: float | None = None
) -> DataFrame:
    """Zero-based position of each row in its run."""
    one = df.withColumn("_one", F.lit(1))
    out = running(one, keys, order, {name: ("count", "_one")}, width).drop("_one")
    return out.withColumn(name, F.col(name) - 1)


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[object, object], tuple[object, list[tuple]]],
    finish: Callable[[object], list[tuple]],
    columns: Sequence[str],
    schema: str,
) -> DataFrame:
    """Order-dependent fold with constant state, streamed rather than collected.

    ``keys`` should include an island number that splits a run wherever the rule cannot
    look across, so that work spreads even when one run dominates. Rows arrive sorted and
    in Arrow batches; only the fold's state is held, never a whole group.
    """
    keys, columns, n_keys = list(keys), list(columns), len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf[keys + list(order_cols)].itertuples(index=False, name=None):
                key, rest = row[:n_keys], row[n_keys:]
                if key != current:
                    if current is not None:
                        out.extend(current + tuple(x) for x in finish(state))
                    current, state = key, None
                state, emitted = step(state, rest)
                out.extend(key + tuple(x) for x in emitted)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if current is not None:
            last = [current + tuple(x) for x in finish(state)]
            if last:
                yield pd.DataFrame(last, columns=columns)

    order_cols = list(order)
    laid_out = df.select(*keys, *order_cols).repartition(*[F.col(k) for k in keys])
    return laid_out.sortWithinPartitions(*keys, *order_cols).mapInPandas(run, schema)
