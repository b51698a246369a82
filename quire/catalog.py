"""Every query of the engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import geometry, layout, library, pages, stream, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (text, layout, geometry, library, pages, stream):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
