"""Every query of the library over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.operators import catalog
from granary.plans import catalog_queries, content_queries, dedup_queries, measure_queries, stream_queries, version_queries  # noqa: F401
from granary.plans.registry import QUERIES, SQL, entries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest files whose path holds a text: filter, order with its tie rule, page."""
    from granary.functions.paths import contains_ascii

    found = entries(spark, sf_dir)
    return catalog.page(found.where(contains_ascii(found["path"], "TXT")), "size", True, 0, 50)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
