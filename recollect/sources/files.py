"""Sources and sinks: annotation JSON, CSV sheets, hit files, uploads, vector files, reports."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIDEO_TYPES = (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """videos[].clips[].annotations[].queries[] of a JSON file, one row per query; what has none keeps a row of nulls."""
    q = "array<struct<query: string, template: string, start_s: double, end_s: double>>"
    schema = f"videos array<struct<video_uid: string, clips: array<struct<clip_uid: string, annotations: array<struct<annotator: string, queries: {q}>>>>>>"
    v = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("videos").alias("v"))
    c = v.select("v.video_uid", F.explode_outer("v.clips").alias("c"))
    a = c.select("video_uid", "c.clip_uid", F.explode_outer("c.annotations").alias("a"))
    return a.select("video_uid", "clip_uid", "a.annotator", F.explode_outer("a.queries").alias("q")).select("video_uid", "clip_uid", "annotator", "q.*")


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header row; blanks are null."""
    return spark.read.csv(path, header=True, schema=schema)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """A file of found windows, space separated, without a header."""
    return spark.read.csv(path, sep=" ", schema="query int, frame_id long, start_s double, end_s double, score double")


def uploads(spark: SparkSession, path: str, most_bytes: int = 500_000_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the reason): files by type and size, without reading their content; the scan leaves out empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    why = F.when(~kind.isin(*VIDEO_TYPES), "not a video").when(F.col("length") > most_bytes, "too large")
    f = f.withColumn("reason", why)
    return f.where("reason is null").drop("reason"), f.where("reason is not null")


def floats_to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


def blob_to_floats(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())


to_blob = F.pandas_udf(floats_to_blob, T.BinaryType())
from_blob = F.pandas_udf(blob_to_floats, T.ArrayType(T.FloatType()))


def vector_file(rows: list[tuple[int, list[float]]]) -> bytes:
    """Count and size, then id and components of each vector, all big-endian."""
    dim = len(rows[0][1]) if rows else 0
    return struct.pack(">ii", len(rows), dim) + b"".join(struct.pack(f">q{dim}f", i, *v) for i, v in rows)


def read_vector_file(data: bytes) -> list[tuple[int, list[float]]]:
    n, dim = struct.unpack_from(">ii", data)
    one = struct.Struct(f">q{dim}f")
    return [(r[0], list(r[1:])) for r in (one.unpack_from(data, 8 + k * one.size) for k in range(n))]


def vector_files(spark: SparkSession, path: str) -> DataFrame:
    """id, v of all vector files below a folder."""
    f = spark.read.format("binaryFile").load(path)
    read = F.udf(read_vector_file, "array<struct<id: bigint, v: array<float>>>")
    return f.select(F.explode(read("content")).alias("r")).select("r.*")


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a result as JSON lines, CSV, ORC or Parquet."""
    w = df.write.mode("overwrite")
    {"json": w.json, "orc": w.orc, "parquet": w.parquet, "csv": lambda p: w.option("header", True).csv(p)}[kind](path)


def random_units(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """id, v: n random directions, the same for the same seed."""
    v = F.array(*[F.randn(seed + i) for i in range(dim)])
    from recollect.functions.vectors import normalized

    return spark.range(n).select("id", normalized(v).alias("v"))


def noisy_copies(units: DataFrame, dim: int, copies: int, noise: float = 0.1, seed: int = 43) -> DataFrame:
    """id, of, v: directions near the given ones."""
    from recollect.functions.vectors import normalized

    e = units.select(F.col("id").alias("of"), "v", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("k"))
    e = e.withColumn("e", F.array(*[F.randn(seed + i) for i in range(dim)]))
    moved = F.zip_with("v", "e", lambda x, y: x + noise * y)
    return e.withColumn("m", moved).select((F.col("of") * copies + F.col("k")).alias("id"), "of", normalized(F.col("m")).alias("v"))
