"""The test tables, and the spelling of video keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def video_key(c: Column | str) -> Column:
    """One spelling per video: lower case, without hyphens, braces and white space. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(c), "-{} \t\r\n", "")


#: The same in DuckDB, for the column named in the braces.
VIDEO_KEY_SQL = "lower(regexp_replace({}, '[-{{}}\\s]', '', 'g'))"


def video_key_sql(column: str) -> str:
    return VIDEO_KEY_SQL.format(column)
