"""All registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans import files, games, ingest, play, policies, redirects, similar, texts, vectors

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [texts, vectors, games, policies, play, files, redirects, ingest, similar]


def queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for module in _MODULES for name, s in module.ORACLES.items()}
