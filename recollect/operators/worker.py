"""Running the stages of queued videos, all videos of a stage at once, and keeping what each has behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import error_text
from recollect.operators.jobs import RETRIES
from recollect.session import checkpointed

Tables = dict[str, DataFrame]
Stage = Callable[[Tables, DataFrame], Tables]


def drain(jobs: DataFrame, tables: Tables, stages: list[tuple[str, Stage]], retries: int = RETRIES) -> tuple[DataFrame, Tables]:
    """jobs: job_id, video_id, status, stage, attempts, error -> jobs and tables once nothing is queued any more.

    A stage gets the tables and the video_ids it is to run for and gives the tables it changes; they are written before
    the stage counts as done. Videos start behind the stage their job has saved. If a stage fails, its videos' jobs are
    tried again from there, up to `retries` times, and then are failed with the error's class and a short message."""
    names = [n for n, _ in stages]
    behind = F.coalesce(*[F.when(F.col("stage") == n, F.lit(k)) for k, n in enumerate(names)], F.lit(-1))
    jobs, tables = checkpointed(jobs), dict(tables)
    while not jobs.where("status = 'queued'").isEmpty():
        jobs = checkpointed(jobs.withColumn("status", F.when(F.col("status") == "queued", "running").otherwise(F.col("status"))))
        for k, (name, stage) in enumerate(stages):
            mine = (F.col("status") == "running") & (behind < k)
            todo = jobs.where(mine).select("video_id").distinct()
            if todo.isEmpty():
                continue
            try:
                tables |= {t: checkpointed(df) for t, df in stage(tables, todo).items()}
                change = {"stage": F.when(mine, F.lit(name)).otherwise(F.col("stage"))}
            except Exception as e:  # noqa: BLE001 - whatever a stage raises is that stage's failure
                n = F.col("attempts") + 1
                why = error_text(F.lit(type(e).__name__), F.lit(str(e)[:200]))
                change = {
                    "status": F.when(mine, F.when(n >= retries, "failed").otherwise("queued")).otherwise(F.col("status")),
                    "error": F.when(mine, why).otherwise(F.col("error")), "attempts": F.when(mine, n).otherwise(F.col("attempts")),
                }
            jobs = checkpointed(jobs.withColumns(change))
        done = F.col("status") == "running"
        jobs = checkpointed(jobs.withColumns({"status": F.when(done, "done").otherwise(F.col("status")), "error": F.when(~done, F.col("error"))}))
    return jobs, tables
