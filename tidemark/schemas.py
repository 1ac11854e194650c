"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

PANEL = "run_id string, row_idx int, t double, unit_id bigint, value double"
UNIT_MAP = "unit_id bigint, region_id int, network_id int, hemisphere string, excluded boolean"
INTERVALS = "run_id string, kind string, idx bigint, start_t double, end_t double, label string, text string"
MANIFEST = "run_id string, cells bigint, units bigint, first_t double, last_t double, total double"
RUN_INDEX = "run_id string, cache_key string, status string, seq bigint"


def require_columns(df, ddl: str) -> None:
    """A table may stand in for a declared one if it has its columns."""
    wanted = [part.split()[0] for part in ddl.split(", ")]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
