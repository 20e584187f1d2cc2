"""The job queue as a fold over events: job_id, seq, event, arg.

enqueue, claim, stage (arg: its name), done, fail (arg: the error), retry, requeue (after a crash), redo (arg: the stage
after which to start again). Events that don't fit the state change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIES = 3
NEW = {"status": None, "stage": None, "attempts": 0, "error": None}


def step(s: dict, event: str, arg: str | None, retries: int = RETRIES) -> dict:
    """The state after one event."""
    now = s["status"]
    if event == "enqueue" and now is None:
        return NEW | {"status": "queued"}
    if event == "claim" and now == "queued":
        return s | {"status": "running"}
    if event == "stage" and now == "running":
        return s | {"stage": arg}
    if event == "done" and now == "running":
        return s | {"status": "done", "error": None}
    if event == "fail" and now == "running":
        n = s["attempts"] + 1
        return s | {"status": "failed" if n >= retries else "queued", "attempts": n, "error": arg}
    if event == "retry" and now == "failed":
        return s | {"status": "queued", "attempts": 0, "error": None}
    if event == "requeue" and now == "running":
        return s | {"status": "queued"}
    if event == "redo" and now == "done":
        return s | {"status": "queued", "stage": arg}
    return s


def _next(s: Column, e: Column, retries: int) -> Column:
    now, kind = s["status"], e["event"]
    n = s["attempts"] + 1

    def to(status=None, stage=None, attempts=None, error=None) -> Column:
        pick = lambda x, old: s[old] if x is None else x
        return F.struct(pick(status, "status").alias("status"), pick(stage, "stage").alias("stage"), pick(attempts, "attempts").alias("attempts"), pick(error, "error").alias("error"))

    none = F.lit(None).cast("string")
    return (
        F.when((kind == "enqueue") & now.isNull(), to(F.lit("queued"), none, F.lit(0), none))
        .when((kind == "claim") & (now == "queued"), to(F.lit("running")))
        .when((kind == "stage") & (now == "running"), to(stage=e["arg"]))
        .when((kind == "done") & (now == "running"), to(F.lit("done"), error=none))
        .when((kind == "fail") & (now == "running"), to(F.when(n >= retries, "failed").otherwise("queued"), attempts=n, error=e["arg"]))
        .when((kind == "retry") & (now == "failed"), to(F.lit("queued"), attempts=F.lit(0), error=none))
        .when((kind == "requeue") & (now == "running"), to(F.lit("queued")))
        .when((kind == "redo") & (now == "done"), to(F.lit("queued"), e["arg"]))
        .otherwise(s)
    )


def fold(events: DataFrame, retries: int = RETRIES) -> DataFrame:
    """job_id, status, stage, attempts, error after all of a job's events, in order of seq. Stays in the JVM."""
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", F.col("arg").cast("string").alias("arg"))))
    g = events.groupBy("job_id").agg(ordered.alias("e"))
    return g.select("job_id", F.aggregate("e", start, lambda s, e: _next(s, e, retries)).alias("s")).select("job_id", "s.*")


def oldest_queued(jobs: DataFrame) -> DataFrame:
    """The job to claim next: none or one row."""
    return jobs.where("status = 'queued'").orderBy("job_id").limit(1)


def behind(jobs: DataFrame, last_stage: str) -> DataFrame:
    """Finished jobs that stopped before today's last stage."""
    return jobs.where((F.col("status") == "done") & ~F.col("stage").eqNullSafe(F.lit(last_stage)))


def redo_after(stages: list[str], changed: list[str]) -> str | None:
    """The stage after which to start again when some stages have changed; None to start from the beginning."""
    first = min((stages.index(s) for s in changed), default=len(stages))
    return stages[first - 1] if first > 0 else None


def serial_start(jobs: DataFrame, group: list[str], created: str, end: str, order: list[str]) -> DataFrame:
    """Adds `began`: a job of a queue that works on one at a time begins once it exists and all earlier ones have ended."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return jobs.withColumn("began", F.greatest(F.col(created), F.max(end).over(w)))


def stream_step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: the same fold, event batch by event batch."""
    s = dict(zip(NEW, state.get)) if state.exists else dict(NEW)
    for row in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
        s = step(s, row.event, None if pd.isna(row.arg) else row.arg)
    state.update(tuple(s.values()))
    yield pd.DataFrame([(key[0], *s.values())], columns=["job_id", *NEW])
