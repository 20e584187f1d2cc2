"""Continuous periods and gaps of overlapping intervals, per entity.

Starts are sorted per entity and compared with the running maximum of the ends before them. One entity may own a
large share of all rows, so the sort runs per (entity, time slice): a small table of slice maxima hands each slice
the largest end of all earlier slices. No task holds more than one slice, and equal starts were merged before.

Defined cases: a null entity, a null or NaN bound, or an end not after its start (after rounding) is ignored; infinite
or absurd bounds are held at +-9e15 ms; repeated rows count once; touching intervals are one period; an empty input
gives an empty result. Input columns besides the named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR_MS = 9.0e15
SLICE_MS = 600_000


def milliseconds(seconds: Column) -> Column:
    return F.round(F.greatest(F.lit(-FAR_MS), F.least(F.lit(FAR_MS), seconds * 1000.0))).cast("long")


def _bounds(df: DataFrame, entity: list[Column], start: str, end: str, slice_ms: int) -> tuple[DataFrame, list[str]]:
    names = [f"k{i}" for i in range(len(entity))]
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    kept = df.where(s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e))
    rows = kept.select(*[c.alias(n) for n, c in zip(names, entity)], milliseconds(s).alias("s"), milliseconds(e).alias("e"))
    rows = rows.where(F.col("e") > F.col("s")).dropna(subset=names)
    # equal starts: the longest covers the rest
    rows = rows.groupBy(*names, "s").agg(F.max("e").alias("e"))
    return rows.withColumn("slice", F.floor(F.col("s") / slice_ms)), names


def _reached(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds `reach`: the largest end among all rows of the entity that start earlier, or null."""
    ahead = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*names, "slice").agg(F.max("e").alias("top"))
    carried = slices.select(*names, "slice", F.max("top").over(ahead).alias("carry"))
    inside = Window.partitionBy(*names, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(carried, [*names, "slice"]).withColumn("reach", F.greatest("carry", F.max("e").over(inside)))


def gaps(df: DataFrame, entity: list[Column], start: str, end: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """k0.., gap_start_ms, gap_end_ms: the stretches of 1 ms or more between two periods of one entity."""
    rows, names = _bounds(df, entity, start, end, slice_ms)
    found = _reached(rows, names).where(F.col("s") > F.col("reach"))
    return found.select(*names, F.col("reach").alias("gap_start_ms"), F.col("s").alias("gap_end_ms"))


def periods(df: DataFrame, entity: list[Column], start: str, end: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """k0.., period_no (from 1), start_ms, end_ms, gap_before_ms (null for the first)."""
    rows, names = _bounds(df, entity, start, end, slice_ms)
    so_far = Window.partitionBy(*names, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("long")
    marked = _reached(rows, names).withColumn("opens", opens).withColumn("local", F.sum("opens").over(so_far))
    # islands of one slice; number 0 goes on from the slice before
    local = marked.groupBy(*names, "slice", "local").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("opens") == 1, F.col("s") - F.col("reach"))).alias("gap")
    )
    ahead = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opened = local.groupBy(*names, "slice").agg(F.max("local").alias("n"))
    before = opened.select(*names, "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    labelled = local.join(before, [*names, "slice"]).withColumn("period_no", F.col("before") + F.col("local"))
    return labelled.groupBy(*names, "period_no").agg(
        F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.max("gap").alias("gap_before_ms")
    )
