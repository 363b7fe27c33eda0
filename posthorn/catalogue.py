"""All queries of the library proper, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from posthorn.queries import analytics, desk, knowledge, linkage, rules, streams, surface, texts

Query = Callable[[SparkSession, str], DataFrame]

_AREAS = (analytics, surface, linkage, texts, streams, knowledge, desk, rules)
QUERIES: dict[str, Query] = {name: q for area in _AREAS for name, q in area.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}
