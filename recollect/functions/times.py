"""Times and places as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO 8601 with Z or an offset, or none (then UTC); null if unreadable."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), F.try_to_timestamp(text))


def moment(recorded_at: Column, t_s: Column) -> Column:
    """The clock time of a point of a video, to the millisecond."""
    ms = F.unix_millis(recorded_at.cast("timestamp")) + F.floor(t_s * 1000 + 0.5).cast("long")
    return F.timestamp_millis(ms)


def stamp_text(ts: Column) -> Column:
    """Always three decimals, so that text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def container_date(text: Column) -> Column:
    """20250102T030405[.678]Z; before 1971 it is a camera without a clock: null."""
    t = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss.SSS'Z'")), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    return F.when(t >= F.lit("1971-01-01").cast("timestamp"), t)


def clock_seconds(text: Column) -> Column:
    """h:m:s or m:s to seconds."""
    p = F.split(F.trim(text), ":")
    n = F.transform(p, lambda x: x.try_cast("double"))
    return F.when(F.forall(n, lambda x: x.isNotNull()), F.aggregate(n, F.lit(0.0), lambda s, x: s * 60 + x))


def location(text: Column) -> Column:
    """ISO 6709, as +12.3456-098.7654+010.0/: struct<lat, lon>, or null."""
    pattern = r"^([+-]\d{1,2}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(text, pattern, k) for k in (1, 2))
    return F.when(lat != "", F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def middle(start: Column, end: Column) -> Column:
    return (start + end) / 2
