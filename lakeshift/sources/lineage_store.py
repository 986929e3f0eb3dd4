"""Lineage-store tables: read them from a catalog/parquet, or from a tab-separated export.

An unaligned, tab-separated text export (one row per line) is parsed with ``split`` with
a part limit, so a name containing a tab keeps its tail in the last column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("datasets", "jobs", "job_versions", "job_versions_io_mapping")


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for the four lineage-store tables under ``root``."""
    return {t: spark.read.format(fmt).load(f"{root}/{t}") for t in TABLES}


def read_tab_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parse a tab-separated text export into named string columns."""
    parts = F.split(F.col("value"), "\t", len(columns))
    return spark.read.text(path).filter(F.col("value") != "").select(*[parts[i].alias(c) for i, c in enumerate(columns)])
