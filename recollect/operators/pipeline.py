"""The indexing stages of videos as table to table functions, each of them safe to run again.

A stage gives the whole new content of its table for the videos it is run on; put() places it over the old rows of
exactly these videos, so a second run gives what the first gave. Models are functions over pandas Series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as ft
from recollect.functions import times
from recollect.functions.boxes import people, things
from recollect.operators import frames as fr
from recollect.operators import moments, tables
from recollect.operators.integrity import messages, problems

STAGES = ["split", "filter", "dedup", "scene", "small_objects", "embed_images", "embed_texts", "link", "latest", "finish"]
FAILED_CAPTION = "[Frame could not be captioned]"


def put(old: DataFrame, new: DataFrame, videos: DataFrame) -> DataFrame:
    """old without the rows of these videos, and new."""
    return old.join(videos.select("video_id").distinct(), "video_id", "left_anti").unionByName(new, allowMissingColumns=True)


def split(videos: DataFrame, fps: float = 3.0) -> DataFrame:
    """video_id, frame_no, t_s, path of the frames to take."""
    t = fr.frame_times(videos, fps)
    return t.select("video_id", F.col("i").alias("frame_no"), F.col("t").alias("t_s"), F.format_string("frames/%06d.jpg", F.col("i")).alias("path"))


def filtered(frames: DataFrame) -> DataFrame:
    """frames with brightness and sharpness -> kept and drop_reason by slots.

    With pixels, width and height, a slot's frame is also dropped as still against the last one kept; one without pixels isn't judged."""
    r = fr.slot_reasons(frames)
    if {"pixels", "width", "height"} <= set(frames.columns):
        still = fr.still_filter(r.where("reason is null and pixels is not null")).withColumnRenamed("reason", "_still")
        r = r.join(still, ["video_id", "frame_no"], "left").withColumn("reason", F.coalesce("reason", "_still")).drop("_still")
    return r.withColumns({"kept": F.col("reason").isNull().cast("int"), "drop_reason": F.col("reason")}).drop("reason", "slot")


def deduplicated(frames: DataFrame) -> DataFrame:
    """frames with hash and v; what an earlier run dropped as a duplicate is judged anew."""
    again = F.coalesce(F.col("drop_reason").startswith("duplicate"), F.lit(False))
    f = frames.withColumns({"kept": F.when(again, 1).otherwise(F.col("kept")), "drop_reason": F.when(~again, F.col("drop_reason"))})
    d = fr.dedup(f.where("kept = 1"))
    j = f.join(d, ["video_id", "frame_no"], "left")
    said = F.concat(F.lit("duplicate of frame "), F.col("duplicate_of").cast("string"))
    return j.withColumns({"kept": F.when(F.col("duplicate_of").isNotNull(), 0).otherwise(F.col("kept")), "drop_reason": F.coalesce(said, F.col("drop_reason"))}).drop("duplicate_of")


def scenes(frames: DataFrame, personal: list[str], own: list[str], shares: dict[str, Column] | None = None) -> DataFrame:
    """frames: video_id, frame_id, objects, place, action -> the same with things only, people, caption.

    shares: of each action's phrase its share in a frame (null without a vector); then the action is that of the largest mean
    share within 6 s of t_s, or none, and frames without shares keep theirs."""
    if shares:
        seen = F.greatest(*shares.values()).isNotNull()
        m = moments.smoothed(frames.withColumn("_seen", seen), "video_id", "t_s", shares)
        frames = m.withColumn("action", F.when(F.col("_seen"), F.col("smooth")).otherwise(F.col("action"))).drop("_seen", "smooth")
    s = frames.withColumns({"people": people(F.col("objects")), "objects": things(F.col("objects"))})
    return s.withColumn("caption", ft.caption(F.col("objects"), personal, own, F.col("people"), F.col("place"), F.col("action")))


def small_objects(scene: DataFrame, found: DataFrame, personal: list[str], own: list[str]) -> DataFrame:
    """scene with its finds of these sources replaced by found (frame_id, objects), captions rewritten."""
    j = scene.join(found.select("frame_id", F.col("objects").alias("_new")), "frame_id", "left")
    rest = F.filter("objects", lambda o: ~o["source"].isin(own))
    o = F.concat(rest, F.coalesce("_new", F.array().cast(scene.schema["objects"].dataType)))
    return j.withColumn("objects", o).drop("_new").withColumn("caption", ft.caption(F.col("objects"), personal, own, F.col("people"), F.col("place"), F.col("action")))


def embedded(rows: DataFrame, saved: DataFrame, key: str, source: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """key, v: saved vectors are used again; the model sees only rows without one."""
    have = saved.select(key, "v")
    new = rows.join(have, key, "left_anti").select(key, F.pandas_udf(model, "array<double>")(F.col(source)).alias("v"))
    return rows.select(key).join(have, key).unionByName(new)


def texts(captions: DataFrame, chunks: DataFrame) -> DataFrame:
    """video_id, source, ref_id, start_s, end_s, text of both."""
    c = captions.where("caption is not null").select("video_id", F.lit("caption").alias("source"), F.col("frame_id").alias("ref_id"), F.col("t_s").alias("start_s"), F.col("t_s").alias("end_s"), F.col("caption").alias("text"))
    t = chunks.where("text is not null and trim(text) <> ''").select("video_id", F.lit("transcript").alias("source"), F.col("id").alias("ref_id"), "start_s", "end_s", "text")
    return c.unionByName(t)


def linked(**tables_of: DataFrame) -> DataFrame:
    """video_id, message of the videos whose rows break a rule; empty when all is well."""
    return messages(problems(**tables_of, by_video=True))


def sightings(scene: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per object: label, frame_id, video_id, seen_at (text of fixed width), place, conf."""
    j = scene.join(videos.select("video_id", "recorded_at"), "video_id")
    o = j.select("video_id", "frame_id", "t_s", "place", "recorded_at", F.explode("objects").alias("o"))
    at = times.stamp_text(times.moment(F.col("recorded_at"), F.col("t_s")))
    return o.select(F.col("o.label").alias("label"), "frame_id", "video_id", at.alias("seen_at"), "place", F.col("o.conf").alias("conf"))


def latest(old: DataFrame, new: DataFrame, videos: DataFrame, least: float = moments.SAME) -> DataFrame:
    """All sightings with is_latest and superseded_by, worked out afresh for every label that the videos touch."""
    labels = old.join(videos.select("video_id").distinct(), "video_id", "left_semi").select("label").unionByName(new.select("label")).distinct()
    now = put(old.drop("is_latest", "superseded_by"), new, videos)
    touched = now.join(labels, "label", "left_semi")
    rest = old.join(labels, "label", "left_anti")
    return touched.join(moments.relink(touched, least), "id").unionByName(rest, allowMissingColumns=True)


def finished(videos: DataFrame, done: DataFrame) -> DataFrame:
    return tables.update(videos, done.select("video_id").distinct().withColumn("status", F.lit("ready")), ["video_id"])


def memories_from_text(docs: DataFrame, size: int = 195, overlap: int = 30) -> DataFrame:
    """id, text -> parent, text, metadata (JSON) of every chunk; blank texts give none."""
    c = docs.where(F.length(F.trim("text")) > 0).select("id", ft.word_chunks(F.trim("text"), size, overlap).alias("c"))
    e = c.select("id", F.size("c").alias("n"), F.posexplode("c").alias("k", "x"))
    meta = F.to_json(F.struct(F.col("k").alias("chunk_index"), F.col("n").alias("total_chunks"), F.col("x.n_words").alias("token_count")))
    return e.select(F.col("id").alias("parent"), F.col("x.chunk").alias("text"), F.lit("text").alias("source_type"), meta.alias("metadata"))


def memories_from_frames(captions: DataFrame, name: Column) -> DataFrame:
    """video_id, frame_no, t_s, caption -> text and metadata of a memory per captioned frame."""
    n = captions.groupBy("video_id").agg(F.count("*").alias("n"))
    j = captions.join(n, "video_id")
    meta = F.to_json(F.struct(name.alias("video_filename"), F.col("t_s").alias("timestamp_seconds"), F.col("frame_no").alias("frame_index"), F.col("n").alias("total_frames")))
    label = F.concat(F.lit("["), ft.clock(F.col("t_s")), F.lit("] "), F.col("caption"))
    return j.select("video_id", label.alias("text"), F.lit("video").alias("source_type"), meta.alias("metadata"))


def captioned(frames: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """frames with caption from a model over `path`; a failure gives a fixed sentence instead of an end of the run."""

    def safe(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            try:
                out.append(model(p))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    return frames.withColumn("caption", F.coalesce(F.pandas_udf(safe, "string")("path"), F.lit(FAILED_CAPTION)))
