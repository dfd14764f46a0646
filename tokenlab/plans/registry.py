"""All queries of the library over the driver's tables, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import features, numbers, recorded, votes

_PARTS = (votes, numbers, features, recorded)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
