"""All queries of the engine outside its optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import batch, causality, changes, details, logs, placing, versions, windows

MODULES = (batch, windows, logs, versions, changes, placing, causality, details)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
