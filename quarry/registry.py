"""All queries of the library proper, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import lookups, manuals, printed, relational, scalar, search, stems, stores, streams, structure, tables  # noqa: F401  (they register their queries)
from quarry.plans.base import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with re-ranking."""
    return search.hybrid(Tables(spark, sf_dir))
