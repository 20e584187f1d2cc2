"""Streams of the store: tumbling and session windows, first deliveries, jobs, the ledger and the text index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import tokens
from recollect.operators import jobs, moments, tables
from recollect.session import checkpointed
from recollect.streaming.run import each_batch


def windowed(events: DataFrame, at: str, by: str, width: str = "15 minutes", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums per window; rows later than `late` behind the newest are dropped, as is any state before.

    late None, for a bounded replay: no row is too late, and all windows are kept as state."""
    g = (events.withWatermark(at, late) if late else events).groupBy(F.window(at, width).alias("w"), by)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions and their counts; late as in windowed(). Without it the stream needs complete mode (run.completed)."""
    g = (events.withWatermark(at, late) if late else events).groupBy(F.session_window(at, gap).alias("w"), by)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_deliveries(rows: DataFrame, at: str, key: str, late: str = "400 days") -> DataFrame:
    """Each key once, the state bounded by the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def job_states(events: DataFrame) -> DataFrame:
    """The state of every job after each batch of its events (job_id, seq, event, arg)."""
    state = "status string, stage string, attempts int, error string"
    return events.withColumn("job_id", F.col("job_id").cast("string")).groupBy("job_id").applyInPandasWithState(jobs.stream_step, "job_id string, " + state, state, "update", "NoTimeout")


BUCKETS = 64  # parts of the ledger's folders, by label; a batch reads the parts of its own labels


def ledger(sightings: DataFrame, name: str, least: float = moments.SAME) -> str:
    """sightings: id, label, frame_id, seen_at, v. Keeps sightings/, open/ (of every label the sightings still the latest after
    each batch that touched it) and ledger/ (the changed states); gives the folder that holds them.

    A label whose new sightings all come after those seen so far goes on from its open ones, so a stream in order costs
    what is new. Lateness has no bound: a label with a sighting from before is worked out afresh from all of its own."""
    spark = sightings.sparkSession
    cols = ["id", "label", "frame_id", "seen_at", "v"]

    def work(batch: DataFrame, at: str, no: int) -> None:
        new = checkpointed(batch.select(*cols).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")))
        parts = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not parts:
            return
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/sightings/b={no}")
        came = new.groupBy("label").agg(F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
        seen = _so_far(spark, f"{at}/sightings", no, parts)
        had = _so_far(spark, f"{at}/open", no, parts)
        if had is None:
            todo = new.select(*cols, F.lit(False).alias("settled"))
            tops = came.select("label", F.col("last").alias("top"))
        else:
            state = had.join(had.groupBy("label").agg(F.max("b").alias("b")), ["label", "b"])
            known = came.join(state.groupBy("label").agg(F.max("top").alias("was")), "label", "left")
            known = checkpointed(known.select("label", (F.col("was").isNotNull() & (F.col("first") <= F.col("was"))).alias("late"), F.greatest("was", "last").alias("top")))
            late, fine = known.where("late").select("label"), known.where("not late").select("label")
            todo = state.join(fine, "label", "left_semi").select(*cols, F.lit(True).alias("settled"))
            todo = todo.unionByName(new.join(fine, "label", "left_semi").select(*cols, F.lit(False).alias("settled")))
            todo = todo.unionByName(seen.join(late, "label", "left_semi").select(*cols, F.lit(False).alias("settled")))
            tops = known.select("label", "top")
        todo = checkpointed(todo)
        now = checkpointed(moments.relink(todo, least))
        now.withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{at}/ledger/b={no}")
        left = todo.select(*cols).join(now.where("is_latest = 1").select("id"), "id").join(tops, "label")
        left.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/open/b={no}")

    return each_batch(sightings, name, work)


def _so_far(spark, folder: str, no: int, parts: list[int]) -> DataFrame | None:
    """The rows of these buckets from the batches up to `no`; None before the first."""
    try:
        return spark.read.option("basePath", folder).parquet(f"{folder}/b=*").where(F.col("bucket").isin(parts) & (F.col("b") <= no))
    except AnalysisException:
        return None


def ledger_now(spark, folder: str) -> DataFrame:
    """The newest state of every sighting."""
    rows = spark.read.parquet(f"{folder}/ledger").drop("b")
    return rows.groupBy("id").agg(F.max_by(F.struct("is_latest", "superseded_by"), "batch").alias("r")).select("id", "r.is_latest", "r.superseded_by")


def text_index(docs: DataFrame, name: str, order: str | None = None, deleted: str | None = None) -> str:
    """docs: id, text -> keeps postings (id, term, tf) of the texts that arrive, and touched (id) of each batch.

    A text that arrives again takes the place of the old one, also when it has become null or has no tokens; a row with a
    true `deleted` takes the text out. Of several rows of one id in a batch the one with the largest `order` counts (any
    of them without `order`)."""

    def work(batch: DataFrame, at: str, no: int) -> None:
        last = tables.newest(batch, ["id"], order) if order else batch.dropDuplicates(["id"])
        last.select("id", F.lit(no).alias("batch")).write.mode("overwrite").parquet(f"{at}/touched/b={no}")
        there = last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last
        t = there.where("text is not null").select("id", F.explode(tokens(F.col("text"))).alias("term"))
        t.groupBy("id", "term").agg(F.count("*").alias("tf")).withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{at}/postings/b={no}")

    return each_batch(docs, name, work)


def index_now(spark, folder: str) -> DataFrame:
    p = spark.read.parquet(f"{folder}/postings").drop("b")
    last = spark.read.parquet(f"{folder}/touched").drop("b").groupBy("id").agg(F.max("batch").alias("batch"))
    return p.join(last, ["id", "batch"]).drop("batch")
