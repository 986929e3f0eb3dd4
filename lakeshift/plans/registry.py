"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle_changelog, oracle_lineage, oracle_paths, oracle_runs, oracle_versioning, queries_changelog, queries_lineage, queries_paths, queries_runs, queries_streaming, queries_versioning

_MODULES = [
    (queries_changelog, oracle_changelog),
    (queries_versioning, oracle_versioning),
    (queries_lineage, oracle_lineage),
    (queries_runs, oracle_runs),
    (queries_paths, oracle_paths),
    (queries_streaming, oracle_changelog),
    (queries_streaming, oracle_lineage),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for q, _ in _MODULES:
        out.update(q.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for _, o in _MODULES:
        out.update(o.SQL)
    return out
