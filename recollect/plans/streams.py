"""Streaming queries: each runs the whole table through as a stream of files and returns what came out."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.plans import analytics, video
from recollect.sources.tables import table
from recollect.streaming import operators, run


def _events(spark, d):
    return run.files(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def x12_windows(spark, d):
    """Counts of events per type and quarter of an hour."""
    out = run.updated(operators.windowed(_events(spark, d), "ts", "event_type", late=None), "windows", ["start", "event_type"])
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def x12_sessions(spark, d):
    """Sessions of each user, parted by half an hour without events, with those still open when the stream ended."""
    out = run.completed(operators.sessions(_events(spark, d), "ts", "user_id", late=None), "sessions")
    return out.select(F.unix_micros("start").alias("start_us"), "user_id", "n")


def x8_whole_index(spark, d):
    """Documents per term, of every term of an index kept up to date as documents arrive."""
    docs = run.files(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    p = operators.index_now(spark, operators.text_index(docs, "index"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def x8_index(spark, d):
    """The terms of x8_whole_index that at least 20 documents hold, as its SQL has them."""
    return x8_whole_index(spark, d).where("df >= 20")


def x6_ledger(spark, d):
    """The ledger of sightings, kept as vectors arrive; the same as working it out at once."""
    e = run.files(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    at = table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"), F.col("user_id").alias("frame_id"))
    return operators.ledger_now(spark, operators.ledger(e.join(at, "id"), "ledger", 0.25))


def x1_job_stream(spark, d):
    """States of jobs that arrive as events of their videos: each delivery is enqueued, claimed, and done or failed."""
    v = run.files(spark, d, "videos").withColumn("video_id", video.video_key("video_id")).where("video_id is not null")
    word = F.when(F.col("status") == "ready", "done").when(F.col("status") == "failed", "fail").otherwise("stage")
    us = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    none = F.lit(None).cast("string")
    e = F.array(*[F.struct((us * 10 + k).alias("seq"), F.lit(w).alias("event") if isinstance(w, str) else w.alias("event"), a.alias("arg")) for k, (w, a) in enumerate((("enqueue", none), ("claim", none), (word, F.col("status"))))])
    events = v.select(F.col("video_id").alias("job_id"), F.explode(e).alias("e")).select("job_id", "e.*")
    return run.updated(operators.job_states(events), "jobs", ["job_id"])


def x10_first_deliveries(spark, d):
    """Memories as they arrive, each id once."""
    m = run.files(spark, d, "memories").withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).select("id", "source_type", "loaded_at")
    return run.appended(operators.first_deliveries(m, "loaded_at", "id").select("id", "source_type"), "memories")


QUERIES = {f.__name__: f for f in (x12_windows, x12_sessions, x8_index, x8_whole_index, x6_ledger, x1_job_stream, x10_first_deliveries)}

SQL = {
    "x1_job_stream": analytics.SQL["x1_jobs"],
    "x12_windows": "SELECT epoch_us(time_bucket(INTERVAL '15 minutes', ts)) start_us, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
    "x6_ledger": video.SQL["w7_relinked"],
    "x12_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) no FROM e) SELECT epoch_us(min(ts)) start_us, user_id, count(*) n FROM g GROUP BY user_id, no""",
    "x8_index": r"""SELECT term, count(DISTINCT doc_id) df, CAST(count(*) AS BIGINT) tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20""",
    "x8_whole_index": r"""SELECT term, count(DISTINCT doc_id) df, CAST(count(*) AS BIGINT) tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "x10_first_deliveries": "SELECT id, source_type FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1",
}
