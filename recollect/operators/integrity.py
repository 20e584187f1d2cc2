"""Integrity rules of the video tables, as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.times import parse_iso


def problems(videos: DataFrame, frames: DataFrame, texts: DataFrame, segments: DataFrame, chunks: DataFrame, image_vec: DataFrame, text_vec: DataFrame, by_video: bool = False, scenes: DataFrame | None = None, windows: DataFrame | None = None, window_vec: DataFrame | None = None) -> DataFrame:
    """rule, n of every rule that some row breaks; with by_video also the video_id.

    The rules' texts are fixed values. Scene records (frame_id), sound windows (id, video_id, start_s, end_s) and their
    vectors (window_id) are judged where they are given. A recording time that is text has to be readable."""
    kept = frames.where("kept = 1")
    length = videos.select("video_id", "duration_s")

    def outside(df: DataFrame) -> DataFrame:
        return df.join(length, "video_id").where("start_s < 0 or end_s < start_s or end_s > duration_s + 1")

    rules = {
        "kept frames without a picture hash": kept.where("phash is null"),
        "kept frames without an image vector": kept.join(image_vec.select(F.col("frame_id").alias("id")).distinct(), "id", "left_anti"),
        "texts without a text vector": texts.join(text_vec.select(F.col("text_id").alias("id")).distinct(), "id", "left_anti"),
        "frames timed outside the video": frames.join(length, "video_id").where("t_s < 0 or t_s > duration_s + 1"),
        "texts timed outside the video": outside(texts),
        "sound segments timed outside the video": outside(segments),
        "transcript chunks timed outside the video": outside(chunks),
        "videos without a usable recording time": videos.where((parse_iso(F.col("recorded_at")) if dict(videos.dtypes)["recorded_at"] == "string" else F.col("recorded_at")).isNull()),
    }
    if scenes is not None:
        rules["kept frames without a scene record"] = kept.join(scenes.select(F.col("frame_id").alias("id")).distinct(), "id", "left_anti")
    if windows is not None:
        rules["sound windows timed outside the video"] = outside(windows)
        if window_vec is not None:
            rules["sound windows without a sound vector"] = windows.join(window_vec.select(F.col("window_id").alias("id")).distinct(), "id", "left_anti")
    keys = ["video_id"] if by_video else []
    out = None
    for rule, rows in rules.items():
        one = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def messages(found: DataFrame) -> DataFrame:
    """video_id, message of a result by video: "3 texts without a text vector; ..."."""
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("rule"))
    return found.groupBy("video_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list(line))).alias("message"))
