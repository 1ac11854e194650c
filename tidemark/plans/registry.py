"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions that mirror ``tidemark.sources.tables``.
ES = """es AS (SELECT user_id AS run_id, event_id AS row_key, epoch_us(ts) / 1e6 AS t,
  event_type AS kind, value FROM events)"""
SP = """sp AS (SELECT l_returnflag AS run_id,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS row_idx,
  l_suppkey AS unit_id, sum(l_extendedprice) / 997 AS value,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS DOUBLE) AS t
  FROM lineitem GROUP BY ALL)"""
UM = """um AS (SELECT s_suppkey AS unit_id,
  CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS region_id,
  CASE WHEN s_acctbal >= 0 THEN n_regionkey END AS network_id,
  CASE WHEN s_nationkey < 13 THEN 'left' ELSE 'right' END AS hemisphere,
  s_acctbal < 0 AS excluded
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
RT = """rt AS (SELECT run_id, row_idx, t, region_id, avg(value) AS value
  FROM sp JOIN um USING (unit_id) WHERE region_id IS NOT NULL GROUP BY ALL)"""
# Users as variants: one row per user and event kind.
KV = """kv AS (SELECT user_id AS run_id, event_type AS kind, count(*) AS n, avg(value) AS mean_value,
  max(value) AS peak_value, stddev_samp(value) AS spread FROM events GROUP BY ALL)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    from tidemark.plans import (  # noqa: F401
        candidate_queries,
        compare_queries,
        content_queries,
        improve_queries,
        panel_queries,
        scoring_queries,
        store_queries,
        surrogate_queries,
        text_queries,
    )
