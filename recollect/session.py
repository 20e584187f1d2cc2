"""Session factory and the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, name: str = "recollect", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    build = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    spark = build.config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder that the session names; a folder of our own only where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="recollect-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return df.checkpoint()


def spread(df: DataFrame, key: str, groups: int, rows_bytes: int = 0) -> DataFrame:
    """df dealt by key to as many tasks as its work needs: groups of few bytes may still cost much time, and a planner that
    only sees bytes would put them together. rows_bytes: all bytes of df, if they may be many."""
    sc = df.sparkSession.sparkContext
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * sc.defaultParallelism, rows_bytes // (64 << 20))
    return df.repartition(max(1, min(groups, tasks)), key)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, so that none needs it on its own path."""
    sc = spark.sparkContext
    if getattr(sc, "_recollect_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="recollect-"), "recollect.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._recollect_shipped = True
