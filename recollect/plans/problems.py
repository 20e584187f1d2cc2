"""Problems 1 to 3 over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.nearby import Spots, containing, near_counts, near_pairs, positions
from recollect.operators.orphans import existing, orphan_keys, orphan_rows, references
from recollect.operators.periods import gaps, periods
from recollect.operators.tables import counts
from recollect.session import checkpointed
from recollect.sources.tables import table, video_key, video_key_sql

NEAR_M = 40.0


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(table(spark, d, "videos"), video_key("video_id"), "lat", "lon")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    points = checkpointed(_positions(spark, d))
    places = table(spark, d, "places").select(F.col("place_id").alias("id"), "outline")
    spots = Spots(points)
    return near_pairs(points, NEAR_M, spots).unionByName(containing(points, places, spots))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every position with the videos at it and those at other positions close to it."""
    return near_counts(Spots(_positions(spark, d)), NEAR_M)


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    videos, frames, chunks, vectors = (table(spark, d, t) for t in ("videos", "frames", "transcript_chunks", "image_vec"))
    removals = table(spark, d, "removals").select(video_key("video_id").alias("video_id"), "removed_at")
    live = existing(videos.select(video_key("video_id").alias("video_id"), "loaded_at"), "video_id", "loaded_at", removals, "removed_at")
    by_video = references(frames, "frames", "id", video_key("video_id")).unionByName(references(chunks, "transcript_chunks", "id", video_key("video_id")))
    by_frame = references(vectors, "image_vec", "frame_id", F.col("frame_id"))
    n = {r.name: r["n"] for r in counts({"videos": videos, "frames": frames, "chunks": chunks, "vectors": vectors}).collect()}
    lost = orphan_keys(by_video, live, n["videos"] + n["frames"] + n["chunks"])
    lost_f = orphan_keys(by_frame, frames.select(F.col("id").alias("key")), n["frames"] + n["vectors"])
    text = lambda df: df.withColumn("key", F.col("key").cast("string"))
    lost = lost.unionByName(text(lost_f))
    return orphan_rows(by_video.unionByName(text(by_frame)), lost, n["frames"] + n["chunks"] + n["vectors"]), lost.drop("n")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows and the different missing keys behind them, per table and month."""
    rows, names = _p2(spark, d)
    return (
        rows.groupBy("src", "ym").agg(F.count("*").alias("n_rows"))
        .join(names.groupBy("src", "ym").agg(F.count("*").alias("n_keys")), ["src", "ym"])
    )


def _both(spark: SparkSession, d: str, made) -> DataFrame:
    one = lambda t: made(table(spark, d, t), [video_key("video_id")], "start_s", "end_s").withColumn("src", F.lit(t))
    return one("audio_segments").unionByName(one("transcript_chunks")).withColumnRenamed("k0", "video_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, gaps).select("src", "video_id", "gap_start_ms", "gap_end_ms")


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every continuous period, numbered per video and table, with the gap before it."""
    return _both(spark, d, periods).select("src", "video_id", "period_no", "start_ms", "end_ms", "gap_before_ms")


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_periods": p3_periods}

_key = video_key_sql("video_id")

_P2 = f"""
WITH gone AS (SELECT {_key} k, max(removed_at) r FROM removals GROUP BY 1),
live AS (SELECT v.k FROM (SELECT {_key} k, max(loaded_at) l FROM videos GROUP BY 1) v LEFT JOIN gone USING (k) WHERE r IS NULL OR l > r),
refs AS (
  SELECT DISTINCT 'frames' src, id row_id, {_key} k, strftime(min(loaded_at) OVER (PARTITION BY id), '%Y-%m') ym FROM frames
  UNION ALL SELECT DISTINCT 'transcript_chunks', id, {_key}, strftime(min(loaded_at) OVER (PARTITION BY id), '%Y-%m') FROM transcript_chunks
  UNION ALL SELECT DISTINCT 'image_vec', frame_id, CAST(frame_id AS VARCHAR), strftime(min(loaded_at) OVER (PARTITION BY frame_id), '%Y-%m') FROM image_vec),
lost AS (
  SELECT * FROM refs WHERE k IS NOT NULL AND (src <> 'image_vec' AND k NOT IN (SELECT k FROM live WHERE k IS NOT NULL)
    OR src = 'image_vec' AND row_id NOT IN (SELECT id FROM frames WHERE id IS NOT NULL)))
"""

_P3 = f"""
WITH raw AS (
  SELECT 'audio_segments' src, {_key} video_id, start_s, end_s FROM audio_segments
  UNION ALL SELECT 'transcript_chunks', {_key}, start_s, end_s FROM transcript_chunks),
r AS (SELECT src, video_id, CAST(round(start_s * 1000) AS BIGINT) s, CAST(round(end_s * 1000) AS BIGINT) e FROM raw
  WHERE video_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND start_s IS NOT NULL AND end_s IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY src, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM r WHERE e > s)
"""

_V1 = f"""
WITH v AS (SELECT DISTINCT {_key} id, lat, lon FROM videos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0))"""

SQL = {
    "p1_counts": _V1 + """,
c AS (SELECT lat, lon, count(*) k, CAST(floor(lat * 1000) AS BIGINT) g, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z FROM v WHERE id IS NOT NULL GROUP BY ALL),
n AS (SELECT *, unnest([g - 1, g, g + 1]) h FROM c),
p AS (SELECT a.lat, a.lon, CAST(sum(b.k) AS BIGINT) near FROM c a JOIN n b ON a.g = b.h AND (a.lat <> b.lat OR a.lon <> b.lon)
  WHERE 2 * 6371008.8 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2)) <= 40 GROUP BY ALL)
SELECT c.lat, c.lon, k n_here, coalesce(near, 0) n_near FROM c LEFT JOIN p ON c.lat = p.lat AND c.lon = p.lon""",
    "p2_found": _P2 + "SELECT DISTINCT src, row_id, ym FROM lost",
    "p2_report": _P2 + "SELECT src, ym, count(DISTINCT row_id) n_rows, count(DISTINCT k) n_keys FROM lost GROUP BY 1, 2",
    "p3_found": _P3 + "SELECT src, video_id, reach gap_start_ms, s gap_end_ms FROM m WHERE s > reach",
    "p3_periods": _P3 + """, n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src, video_id ORDER BY s, e) no FROM m)
SELECT src, video_id, CAST(no AS BIGINT) period_no, min(s) start_ms, max(e) end_ms, max(CASE WHEN s > reach THEN s - reach END) gap_before_ms FROM n GROUP BY 1, 2, 3""",
    "p1_found": f"""
WITH v AS (SELECT DISTINCT {_key} id, lat, lon FROM videos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)),
u AS (SELECT *, CAST(floor(lat * 1000) AS BIGINT) g, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z FROM v),
n AS (SELECT *, unnest([g - 1, g, g + 1]) h FROM u),
pairs AS (SELECT DISTINCT a.id id_a, b.id id_b FROM u a JOIN n b ON a.g = b.h AND a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2)) <= 40),
c AS (SELECT place_id, unnest(outline) p, generate_subscripts(outline, 1) i, len(outline) n FROM places),
k AS (SELECT place_id, i, p.lat lat, p.lon lon FROM c),
f AS (SELECT place_id, first(lat ORDER BY i) la, first(lon ORDER BY i) lo, last(lat ORDER BY i) lb, last(lon ORDER BY i) lob, max(i) m FROM k GROUP BY 1),
kk AS (SELECT k.* FROM k JOIN f USING (place_id) WHERE NOT (la = lb AND lo = lob AND i = m)),
ok AS (SELECT place_id FROM kk GROUP BY 1 HAVING count(*) >= 3 AND count(lat) = count(*) AND count(lon) = count(*)),
e AS (SELECT place_id, lat, lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) lat1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) lon1
  FROM kk SEMI JOIN ok USING (place_id) WINDOW w AS (PARTITION BY place_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CASE WHEN lon1 - lon > 180 THEN lon1 - 360 WHEN lon1 - lon < -180 THEN lon1 + 360 ELSE lon1 END lon2 FROM e),
g AS (SELECT place_id, CASE WHEN lon < lon2 THEN lon ELSE lon2 END x0, CASE WHEN lon < lon2 THEN lat ELSE lat1 END y0,
  CASE WHEN lon < lon2 THEN lon2 ELSE lon END x1, CASE WHEN lon < lon2 THEN lat1 ELSE lat END y1 FROM d WHERE lon <> lon2),
s AS (SELECT place_id, x0 + o x0, y0, x1 + o x1, y1 FROM g, (VALUES (-360), (0), (360)) t(o) WHERE x1 + o > -180 AND x0 + o < 180),
hit AS (SELECT v.id id_a, s.place_id id_b FROM (SELECT id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END lon FROM v) v
  JOIN s ON v.lon >= s.x0 AND v.lon < s.x1 AND greatest(y0, y1) > v.lat
  WHERE y0 + (v.lon - x0) * ((y1 - y0) / (x1 - x0)) > v.lat GROUP BY v.id, v.lat, v.lon, s.place_id HAVING count(*) % 2 = 1)
SELECT id_a, id_b FROM pairs UNION SELECT id_a, id_b FROM hit""",
}
