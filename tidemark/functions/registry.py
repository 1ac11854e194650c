"""Named registries of column builders: metrics, mutations, acquisitions, regressors.

An entry must document itself and may be registered once. Builders return Spark columns
(or estimators), so everything registered runs inside the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[..., Any]
    formula: str
    limitations: str
    flags: frozenset[str] = field(default_factory=frozenset)


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._entries: dict[str, Entry] = {}

    def add(
        self, name: str, build: Callable[..., Any], formula: str, limitations: str, *flags: str
    ) -> None:
        if not formula.strip() or not limitations.strip():
            raise ValueError(f"{self.kind} {name} is undocumented")
        if name in self._entries:
            raise ValueError(f"{self.kind} {name} is already registered")
        self._entries[name] = Entry(name, build, formula, limitations, frozenset(flags))

    def get(self, name: str) -> Entry:
        if name not in self._entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self._entries)}")
        return self._entries[name]

    def require(self, names: list[str]) -> None:
        """Allowlist check, made before any plan is built."""
        unknown = sorted(set(names) - set(self._entries))
        if unknown:
            raise ValueError(f"unsupported {self.kind}: {unknown}")

    def __iter__(self) -> Iterator[Entry]:
        return iter(self._entries.values())


def _finite_count() -> Column:
    return F.count("value")


METRICS = Registry("metric")
METRICS.add(
    "MEAN_RESPONSE", lambda: F.avg("value"), "mean of finite samples in the window",
    "hides shape; signed values can cancel",
)
METRICS.add(
    "PEAK_RESPONSE", lambda: F.max("value"), "largest finite sample in the window",
    "decided by one sample", "decomposes",
)
METRICS.add(
    "INTEGRATED_RESPONSE",
    lambda: F.when(
        _finite_count() >= 2,
        F.sum((F.col("value") + F.col("prev.value")) / 2 * (F.col("t") - F.col("prev.t"))),
    ),
    "trapezoid integral over finite samples on their own times",
    "spans gaps in straight lines; grows with the window", "decomposes",
)
METRICS.add(
    "RESPONSE_STABILITY", lambda: F.stddev_samp("value"), "sample standard deviation (n - 1)",
    "needs two samples; lower is steadier",
)
METRICS.add(
    "TEMPORAL_CHANGE_MAGNITUDE", lambda: F.avg(F.abs(F.col("value") - F.col("prev.value"))),
    "mean absolute step between consecutive finite samples", "ignores uneven spacing",
)
# The two below need a second input and are built by their own operators.
METRICS.add(
    "PATTERN_SIMILARITY_TO_REFERENCE", lambda: F.lit(None).cast("double"),
    "cosine of the window's mean unit pattern with a reference", "measures direction, not size", "reference",
)
METRICS.add(
    "DIVERGENCE_FROM_BASELINE", lambda: F.lit(None).cast("double"),
    "root mean square difference from the baseline, paired by position", "sign is lost", "baseline",
)
