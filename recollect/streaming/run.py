"""Running a bounded stream to its end into Parquet, and reading the result back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; in local mode below a temporary one."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "recollect-streams")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, folder: str, name: str, per_batch: int = 4) -> DataFrame:
    """The table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path + "*" if os.path.isfile(path) else path)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows that an append stream gives until its input is used up."""
    at = work_folder(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", at + "/state").option("path", at + "/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(at + "/out")


def updated(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last row of each key of an update stream."""
    spark, at = stream.sparkSession, work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, no: int) -> None:
        batch.withColumn("_batch", F.lit(no)).write.mode("overwrite").parquet(f"{at}/out/b={no}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", at + "/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out").drop("b")
    cols = [c for c in out.columns if c not in (*keys, "_batch")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def completed(stream: DataFrame, name: str) -> DataFrame:
    """The whole result of an aggregation once its input is used up; each batch's takes the place of the one before."""
    spark, at = stream.sparkSession, work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", at + "/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def each_batch(stream: DataFrame, name: str, work) -> str:
    """work(batch, folder, number) for every micro-batch; gives the folder."""
    at = work_folder(stream.sparkSession, name)
    q = stream.writeStream.option("checkpointLocation", at + "/state").foreachBatch(lambda b, no: work(b, at, no)).trigger(availableNow=True).start()
    q.awaitTermination()
    return at
