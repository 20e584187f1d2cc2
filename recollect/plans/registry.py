"""All queries outside the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.plans import analytics, problems, retrieval, store, streams, video

MODULES = [problems, retrieval, video, analytics, store, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for m in MODULES for name, made in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.flagship(spark, folder)
