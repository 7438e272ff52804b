"""All registered queries outside the corpus package, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotation, detection, forms, learning, records, segmentation, streams, traces, trajectories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (detection, annotation, segmentation, traces, trajectories, learning, records, forms, streams):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes matched, and their detection measures."""
    return detection.detection_summary(spark, sf_dir)
