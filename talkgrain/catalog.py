"""All registered queries on the shared tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgrain.plans import corpus, evidence, indexes, knowledge, lifecycle, pages, search, signals, streams, telemetry  # noqa: F401  (they register their queries)
from talkgrain.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_rrf_search(spark, sf_dir)
