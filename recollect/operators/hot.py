"""Joins on keys of which few may hold a large share of all rows.

A hot key's rows are dealt to several tasks by a salt; the other side's rows of that key are sent to each of them. Which
keys are hot comes from counts that the caller has anyway. With the threshold at rows / MOST_HOT there are at most
MOST_HOT hot keys, whatever the table, so their list can be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 65_536  # rows of one key that one task may get
MOST_HOT = 2_000


def hot_keys(counts: DataFrame, keys: list[str], rows: int, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """keys.., splits of the keys with more rows than a task should get. counts: keys.., n; rows: the sum of n, or a bound on it."""
    most = max(hot_rows, -(-rows // MOST_HOT))
    return counts.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("splits"))


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """big join other on keys (inner, left, left_semi or left_anti); big's hot keys are dealt by the columns `by`."""
    parts = F.coalesce(F.col("splits"), F.lit(1))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("splits")
    sent = other.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("splits")
    return dealt.join(sent, [*keys, "_salt"], how).drop("_salt")
