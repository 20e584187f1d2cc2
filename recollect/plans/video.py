"""Queries over videos, frames, segments and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as ft
from recollect.functions import times, vectors
from recollect.operators import frames as fr
from recollect.operators import moments, tables
from recollect.operators.integrity import problems
from recollect.session import checkpointed
from recollect.sources.tables import table, video_key, video_key_sql

LANGS = ["en", "de", "es", "fr", "ru", "ur", "zh"]


def keyed(spark: SparkSession, d: str, name: str, key: str = "id") -> DataFrame:
    """One row per id, its video key in one spelling."""
    return tables.newest(table(spark, d, name), [key], "loaded_at").withColumn("video_id", video_key("video_id"))


def videos(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").withColumn("video_id", video_key("video_id")).where(F.col("video_id").isNotNull())
    return tables.newest(v, ["video_id"], "loaded_at")


def removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "removals").withColumn("video_id", video_key("video_id")).where(F.col("video_id").isNotNull())


def vectors_of(spark: SparkSession, d: str, name: str, key: str, dim: int) -> DataFrame:
    v = tables.newest(table(spark, d, name), [key], "loaded_at").select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0.0))


def j6_video_list(spark, d):
    """Every video with its newest state, last removal and the numbers of kept frames, speech segments and chunks."""
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    last = removed(spark, d).groupBy("video_id").agg(F.max("removed_at").alias("removed_at"))
    out = videos(spark, d).select("video_id", "status").join(last, "video_id", "left")
    out = out.join(n(keyed(spark, d, "frames").where("kept = 1"), "n_kept"), "video_id", "left")
    out = out.join(n(keyed(spark, d, "audio_segments").where("is_speech = 1"), "n_speech"), "video_id", "left")
    out = out.join(n(keyed(spark, d, "transcript_chunks"), "n_chunks"), "video_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_kept", "n_speech", "n_chunks")}
    return out.withColumns(zero).withColumn("removed_at", F.unix_micros(F.col("removed_at").cast("timestamp")))


def a5_integrity(spark, d):
    return problems(
        videos(spark, d), keyed(spark, d, "frames"), keyed(spark, d, "video_texts"), keyed(spark, d, "audio_segments"), keyed(spark, d, "transcript_chunks"),
        table(spark, d, "image_vec"), table(spark, d, "text_vec"),
    )


def s9_cascade_counts(spark, d):
    """Rows left in each table once the removed videos and all that hangs on them are deleted."""
    t = {n: keyed(spark, d, n) for n in ("frames", "audio_segments", "transcript_chunks", "video_texts")}
    t |= {"videos": videos(spark, d), "image_vec": table(spark, d, "image_vec"), "text_vec": table(spark, d, "text_vec")}
    children = {n: ("videos", "video_id", "video_id") for n in ("frames", "audio_segments", "transcript_chunks", "video_texts")}
    children |= {"image_vec": ("frames", "frame_id", "id"), "text_vec": ("video_texts", "text_id", "id")}
    return tables.counts(tables.delete_cascade(t, removed(spark, d), "videos", "video_id", children))


def s5_upserted(spark, d):
    """Early deliveries of the memories, and all later ones put over them."""
    m = table(spark, d, "memories").select("id", "source_type", "loaded_at")
    cut = F.lit("2025-07-01").cast("timestamp_ntz")
    old = tables.newest(m.where(F.col("loaded_at") < cut), ["id"], "loaded_at")
    both = tables.upsert(old, m.where(~(F.col("loaded_at") < cut)), ["id"], "loaded_at")
    return both.select("id", "source_type", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"))


def s6_updated(spark, d):
    gone = removed(spark, d).select("video_id", F.lit("removed").alias("status")).distinct()
    return tables.update(videos(spark, d).select("video_id", "status"), gone, ["video_id"])


def s4_appended(spark, d):
    """The removals numbered on from the last memory."""
    new = removed(spark, d).select("video_id", F.unix_micros(F.col("removed_at").cast("timestamp")).alias("at")).distinct()
    old = table(spark, d, "memories").select("id", F.lit(None).cast("string").alias("video_id"), F.lit(None).cast("long").alias("at"))
    return tables.append_with_ids(old, new, ["at", "video_id"]).where("video_id is not null")


def a2_stamps(spark, d):
    """Number of rows and largest id of every table with ids: changes when rows arrive."""
    keys = {"frames": "id", "audio_segments": "id", "transcript_chunks": "id", "video_texts": "id", "memories": "id", "image_vec": "frame_id", "text_vec": "text_id"}
    out = None
    for name, key in keys.items():
        one = tables.stamp(table(spark, d, name), key).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def s22_frame_times(spark, d):
    """Number and last time of the frames that 3 a second give for every video."""
    t = fr.frame_times(videos(spark, d).select("video_id", "duration_s"), 3.0)
    return t.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.max("t"), 6).alias("last_t"))


def s23_asof_frame(spark, d):
    """The first frame at or after the start of every chunk."""
    c = keyed(spark, d, "transcript_chunks").where("video_id is not null and start_s is not null and not isnan(start_s)").select("id", "video_id", "start_s")
    f = keyed(spark, d, "frames").where("video_id is not null and t_s is not null and not isnan(t_s)").select("video_id", "t_s")
    return moments.asof_forward(c, f, "video_id", "start_s", "t_s").select("id", "found")


def s23_served(spark, d):
    """The same when each frame may serve one chunk only."""
    c = keyed(spark, d, "transcript_chunks").where("video_id is not null and start_s is not null and not isnan(start_s)")
    f = keyed(spark, d, "frames").where("video_id is not null and t_s is not null and not isnan(t_s)")
    return moments.serve_in_order(c, f, "video_id", "start_s", "t_s")


def _measured(spark, d):
    """Frames with stand-in measures from the bits of their hash."""
    h = vectors.hash_bits(F.col("phash"))
    f = keyed(spark, d, "frames").where("video_id is not null and frame_no is not null").withColumn("hash", h)
    return f.select("id", "video_id", F.col("frame_no").cast("long").alias("frame_no"), "t_s", "kept", "hash", (F.bit_count("hash") * 6.0 - 60).alias("brightness"), (F.pmod("hash", F.lit(1009)) * 1.0).alias("sharpness"))


def w3_slot_reasons(spark, d):
    return fr.slot_reasons(_measured(spark, d)).select("id", "video_id", "frame_no", "slot", "reason")


def w5_dedup(spark, d):
    """Near-duplicates among the kept frames of each video by hash, then by vector."""
    f = _measured(spark, d).where("kept = 1")
    v = vectors_of(spark, d, "image_vec", "frame_id", 128).select("id", vectors.normalized(F.col("v")).alias("v"))
    return fr.dedup(f.join(v, "id", "left"))


def w9_motion_paced(spark, d):
    f = _measured(spark, d)
    w = Window.partitionBy("video_id").orderBy("frame_no", "id")
    moving = f.withColumn("motion", vectors.hamming(F.col("hash"), F.lag("hash").over(w)).cast("double"))
    return fr.motion_paced(moving.withColumn("sharpness", F.coalesce("sharpness", F.lit(0.0))), 100.0, 12)


def w11_spaced(spark, d):
    n = keyed(spark, d, "frames").where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("total"))
    return fr.spaced(n, 7)


def w11_uniform(spark, d):
    t = fr.uniform_times(videos(spark, d).where("not isnan(duration_s)").select("video_id", "duration_s"), 5)
    return t.select("video_id", "i", F.round("t", 6).alias("t"))


def w8_runs(spark, d):
    """Stretches of frames dropped for one and the same reason."""
    f = keyed(spark, d, "frames").where("video_id is not null and t_s is not null and not isnan(t_s)").select("id", "video_id", "frame_no", "t_s", "drop_reason")
    return moments.runs(f, ["video_id"], ["t_s", "frame_no", "id"], "drop_reason", "t_s")


def w2_smoothed(spark, d):
    """The language of every chunk, smoothed over the chunks within 6 s."""
    c = keyed(spark, d, "transcript_chunks").where("video_id is not null and start_s is not null and not isnan(start_s)")
    shares = {g: F.when(F.col("lang").isNotNull() & F.col("confidence").isNotNull(), F.when(F.col("lang") == g, F.col("confidence")).otherwise(0.0)) for g in LANGS}
    return moments.smoothed(c, "video_id", "start_s", shares).select("id", "smooth")


def _scored_frames(spark, d):
    """Kept frames of ready videos with their likeness to the first usable vector; only (id, score) goes through the newest-row step."""
    v = table(spark, d, "image_vec").select("frame_id", "loaded_at", F.col("embedding").cast("array<double>").alias("v"))
    ok = (F.size("v") == 128) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0.0)
    first = v.where(ok).groupBy("frame_id").agg(F.max_by("v", "loaded_at").alias("v")).orderBy("frame_id").limit(1)
    q = first.select(vectors.normalized(F.col("v")).alias("q"))
    s = v.crossJoin(F.broadcast(q)).select("frame_id", "loaded_at", F.when(ok, vectors.dot(F.col("v"), F.col("q")) / vectors.norm(F.col("v"))).alias("score"))
    s = tables.newest(s, ["frame_id"], "loaded_at").where("score is not null").select(F.col("frame_id").alias("id"), "score")
    ready = videos(spark, d).where("status = 'ready'").select("video_id")
    f = keyed(spark, d, "frames").where("kept = 1 and video_id is not null and t_s is not null and not isnan(t_s)").join(ready, "video_id", "left_semi")
    return f.select("id", "video_id", "t_s").join(s, "id")


def r19_moments(spark, d):
    """The 20 best moments like the first frame, with the frame's file and caption."""
    hits = checkpointed(moments.moment_search(_scored_frames(spark, d)))  # 20 rows
    few = F.broadcast(hits.select("id"))
    files = tables.newest(table(spark, d, "frames").join(few, "id", "left_semi"), ["id"], "loaded_at").select("id", "file_path")
    t = table(spark, d, "video_texts").join(few, F.col("ref_id") == few["id"], "left_semi")  # ref_id of one text never changes
    words = tables.newest(t, ["id"], "loaded_at").where("source = 'caption'").groupBy(F.col("ref_id").alias("id")).agg(F.min("text").alias("caption"))
    out = hits.join(files, "id", "left").join(words, "id", "left")
    return out.withColumns({c: F.round(c, 4) for c in ("score", "start_s", "end_s")})


def r23_caption_windows(spark, d):
    """The different texts of every 30 s of a video in the order in which they first come."""
    t = keyed(spark, d, "video_texts").where("video_id is not null and text is not null and start_s is not null and not isnan(start_s)")
    t = t.withColumn("win", F.floor(F.col("start_s") / 30).cast("long"))
    first = t.groupBy("video_id", "win", "text").agg(F.min(F.struct("start_s", "id")).alias("at"))
    seq = F.array_sort(F.collect_list(F.struct("at", "text")))
    return first.groupBy("video_id", "win").agg(F.concat_ws(" . ", F.transform(seq, lambda x: x["text"])).alias("caption"))


def _sightings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    at = table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"), F.col("user_id").alias("frame_id"))
    return e.join(at, "id")


def w7_relinked(spark, d):
    """Which sightings of each label are the latest, at a likeness that these vectors reach."""
    return moments.relink(_sightings(spark, d), 0.25)


def j15_last_seen(spark, d):
    """When something like every 100th vector was seen last before it, among those of its label."""
    s = _sightings(spark, d)
    asks = s.where("id % 100 = 0").select("label", F.col("id").alias("ask"), F.col("seen_at").alias("at"), F.col("v").alias("q"))
    return moments.last_seen(asks, s.select("label", F.col("seen_at").alias("t"), "v"), ["label"], 0.25)


def _spans(spark, d):
    c = keyed(spark, d, "transcript_chunks")
    ok = "video_id is not null and not isnan(start_s) and not isnan(end_s) and end_s >= start_s"
    return c.where(ok).select(F.col("id").alias("chunk"), "video_id", "lang", "start_s", "end_s")


def _kept(spark, d):
    return keyed(spark, d, "frames").where("kept = 1 and video_id is not null and t_s is not null and not isnan(t_s)").select("id", "video_id", "t_s")


def j11_moment_recall(spark, d):
    """Chunks with a kept frame within a second of them, by language and in all."""
    spans = _spans(spark, d)
    hit = moments.points_in(_kept(spark, d), spans, "video_id", "t_s", "start_s", "end_s", 1.0).select("chunk").distinct().withColumn("hit", F.lit(1))
    j = spans.join(hit, "chunk", "left").withColumn("lang", F.coalesce("lang", F.lit("unknown")))
    out = j.rollup("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return out.withColumns({"lang": F.coalesce("lang", F.lit("all")), "recall": F.round(F.col("hits") / F.col("n"), 6)})


def j12_wasted(spark, d):
    """Kept frames that no chunk covers, per video."""
    k = _kept(spark, d)
    used = moments.points_in(k, _spans(spark, d), "video_id", "t_s", "start_s", "end_s", 1.0).select("id").distinct()
    return k.join(used, "id", "left_anti").groupBy("video_id").agg(F.count("*").alias("n_wasted"))


def j14_tiou(spark, d):
    """How many chunks some sound segment covers at an overlap of .3 and of .5, by language."""
    a = keyed(spark, d, "audio_segments").where("video_id is not null and not isnan(start_s) and not isnan(end_s) and end_s >= start_s").select("video_id", F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    m = moments.overlapping(_spans(spark, d), a, "video_id", "start_s", "end_s", "a0", "a1")
    best = m.groupBy("chunk").agg(F.max(moments.tiou(F.col("a0"), F.col("a1"), F.col("start_s"), F.col("end_s"))).alias("best"))
    j = _spans(spark, d).join(best, "chunk", "left").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang"))
    at = lambda x: F.sum(F.when(F.col("best") >= x, 1).otherwise(0))
    return j.agg(F.count("*").alias("n"), at(0.3).alias("at_3"), at(0.5).alias("at_5"))


def m3_prompts(spark, d):
    """Which of the first five image vectors each one is most like, by shares of their likeness."""
    v = vectors_of(spark, d, "image_vec", "frame_id", 128).select("id", vectors.normalized(F.col("v")).alias("v"))
    p = v.orderBy("id").limit(5).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("p"))
    s = v.crossJoin(F.broadcast(p)).withColumn("s", vectors.softmax(F.transform("p", lambda x: vectors.dot(F.col("v"), x["v"]))))
    return s.select("id", vectors.best_prompt(F.col("s"), F.transform("p", lambda x: x["id"].cast("string"))).alias("best"), F.round(F.array_max("s"), 6).alias("share"))


def m21_hamming(spark, d):
    """Bits in which the hash of each frame differs from that of the frame before."""
    f = _measured(spark, d)
    w = Window.partitionBy("video_id").orderBy("frame_no", "id")
    return f.select("id", vectors.hamming(F.col("hash"), F.lag("hash").over(w)).alias("bits")).where("bits is not null")


def d2_clock_times(spark, d):
    """The clock time of every frame, as text."""
    f = keyed(spark, d, "frames").where("t_s is not null and not isnan(t_s)").select("id", "video_id", "t_s")
    j = f.join(videos(spark, d).where("recorded_at is not null").select("video_id", "recorded_at"), "video_id")
    return j.select("id", times.stamp_text(times.moment(F.col("recorded_at"), F.col("t_s"))).alias("at"))


def f10_labels(spark, d):
    """Captions behind their time."""
    t = keyed(spark, d, "video_texts").where("start_s >= 0 and not isnan(start_s) and text is not null")
    return t.select("id", F.concat(F.lit("["), ft.clock(F.col("start_s")), F.lit("] "), ft.preview(F.col("text"), 65)).alias("label"))


def f9_captions(spark, d):
    """Captions of all videos, with speakers in the place of things."""
    c = keyed(spark, d, "transcript_chunks").where("video_id is not null and speaker is not null and confidence is not null")
    per = c.groupBy("video_id", "speaker", "lang").agg(F.max("confidence").alias("conf"))
    o = per.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("speaker").alias("label"), F.col("conf"), F.coalesce("lang", F.lit("")).alias("source")))).alias("o"), F.countDistinct("speaker").alias("n"))
    return o.select("video_id", ft.caption(F.col("o"), ["S2"], ["de"], F.col("n"), F.lit("inside a car"), F.lit(None).cast("string")).alias("caption"))


def u1_texts_by_time(spark, d):
    """Captions and transcripts together, numbered by time within their video."""
    t = keyed(spark, d, "video_texts").where("video_id is not null and start_s is not null and not isnan(start_s)")
    both = t.where("source = 'caption'").unionByName(t.where("source = 'transcript'"))
    return both.select("id", "video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "id")).cast("long").alias("place"))


def w14_chunks(spark, d):
    """Memories cut into runs of 195 words that share 30."""
    m = tables.newest(table(spark, d, "memories"), ["id"], "loaded_at").where("text is not null")
    made = m.select("id", F.posexplode(ft.word_chunks(F.col("text"))).alias("chunk_index", "c"))
    return made.select("id", "chunk_index", F.col("c.n_words").cast("long").alias("n_words"), F.md5("c.chunk").alias("digest"))


def s11_vector_codec(spark, d):
    """Sizes of the vectors that the memories' JSON holds; unreadable ones are empty."""
    m = tables.newest(table(spark, d, "memories"), ["id"], "loaded_at")
    v = F.coalesce(F.from_json("embedding", "array<double>"), F.array().cast("array<double>"))
    back = F.from_json(F.to_json(v), "array<double>")
    return m.select("id", F.size(v).cast("long").alias("n"), F.size(back).cast("long").alias("n_back"))


def s14_metadata(spark, d):
    """The memories' metadata; what can't be read is empty."""
    m = tables.newest(table(spark, d, "memories"), ["id"], "loaded_at")
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return m.select("id", meta["chunk_index"].alias("chunk_index"), meta["total_chunks"].alias("total_chunks"))


QUERIES = {f.__name__: f for f in (
    j6_video_list, a5_integrity, s9_cascade_counts, s5_upserted, s6_updated, s4_appended, a2_stamps, s22_frame_times, s23_asof_frame, s23_served, w3_slot_reasons,
    w5_dedup, w9_motion_paced, w11_spaced, w11_uniform, w8_runs, w2_smoothed, r19_moments, r23_caption_windows, w7_relinked, j15_last_seen, j11_moment_recall,
    j12_wasted, j14_tiou, m3_prompts, m21_hamming, d2_clock_times, f10_labels, f9_captions, u1_texts_by_time, w14_chunks, s11_vector_codec, s14_metadata)}

_key = video_key_sql("video_id")


def _newest(name: str, key: str = "id") -> str:
    return f"(SELECT * REPLACE ({_key} AS video_id) FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


_VID = f"(SELECT * REPLACE ({_key} AS video_id) FROM videos WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY loaded_at DESC) = 1)"
_REM = f"(SELECT * REPLACE ({_key} AS video_id) FROM removals WHERE video_id IS NOT NULL)"
_FR, _AU, _TC, _VT = (_newest(n) for n in ("frames", "audio_segments", "transcript_chunks", "video_texts"))


def _vec(name: str, key: str, dim: int) -> str:
    return f"""(SELECT id, v FROM (SELECT {key} id, CAST(embedding AS DOUBLE[]) v FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)
WHERE len(v) = {dim} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)"""


_OUT = "(x.start_s < 0 OR x.end_s < x.start_s OR x.end_s > v.duration_s + 1)"
_SPAN = f"(SELECT id chunk, video_id, lang, start_s, end_s FROM {_TC} WHERE video_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s >= start_s)"
_KEPT = f"(SELECT id, video_id, t_s FROM {_FR} WHERE kept = 1 AND video_id IS NOT NULL AND NOT isnan(t_s))"
_HASH = f"(SELECT *, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT) h FROM (SELECT *, CAST('0x' || phash AS UBIGINT) u FROM {_FR} WHERE video_id IS NOT NULL AND frame_no IS NOT NULL))"
_SIGHT = "(SELECT vec_id id, CAST(label AS VARCHAR) label, CAST(embedding AS DOUBLE[]) v, epoch_us(ts) seen_at FROM embeddings JOIN events ON vec_id = event_id)"

SQL = {
    "j6_video_list": f"""SELECT v.video_id, v.status, epoch_us(r."at") removed_at, coalesce(f.n, 0) n_kept, coalesce(s.n, 0) n_speech, coalesce(c.n, 0) n_chunks FROM {_VID} v
LEFT JOIN (SELECT video_id, max(removed_at) "at" FROM {_REM} GROUP BY 1) r USING (video_id) LEFT JOIN (SELECT video_id, count(*) n FROM {_FR} WHERE kept = 1 GROUP BY 1) f USING (video_id)
LEFT JOIN (SELECT video_id, count(*) n FROM {_AU} WHERE is_speech = 1 GROUP BY 1) s USING (video_id) LEFT JOIN (SELECT video_id, count(*) n FROM {_TC} GROUP BY 1) c USING (video_id)""",
    "a5_integrity": f"""SELECT rule, n FROM (
SELECT 'kept frames without a picture hash' rule, count(*) n FROM {_FR} WHERE kept = 1 AND phash IS NULL
UNION ALL SELECT 'kept frames without an image vector', count(*) FROM {_FR} f WHERE kept = 1 AND NOT EXISTS (SELECT 1 FROM image_vec v WHERE v.frame_id = f.id)
UNION ALL SELECT 'texts without a text vector', count(*) FROM {_VT} t WHERE NOT EXISTS (SELECT 1 FROM text_vec v WHERE v.text_id = t.id)
UNION ALL SELECT 'frames timed outside the video', count(*) FROM {_FR} x JOIN {_VID} v USING (video_id) WHERE x.t_s < 0 OR x.t_s > v.duration_s + 1
UNION ALL SELECT 'texts timed outside the video', count(*) FROM {_VT} x JOIN {_VID} v USING (video_id) WHERE {_OUT}
UNION ALL SELECT 'sound segments timed outside the video', count(*) FROM {_AU} x JOIN {_VID} v USING (video_id) WHERE {_OUT}
UNION ALL SELECT 'transcript chunks timed outside the video', count(*) FROM {_TC} x JOIN {_VID} v USING (video_id) WHERE {_OUT}
UNION ALL SELECT 'videos without a usable recording time', count(*) FROM {_VID} WHERE recorded_at IS NULL) WHERE n > 0""",
    "s9_cascade_counts": f"""WITH g AS (SELECT DISTINCT v.video_id k FROM {_VID} v JOIN {_REM} r USING (video_id)), f AS (SELECT * FROM {_FR}), t AS (SELECT * FROM {_VT})
SELECT 'videos' name, count(*) n FROM {_VID} WHERE video_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'frames', count(*) FROM f WHERE video_id IS NULL OR video_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'video_texts', count(*) FROM t WHERE video_id IS NULL OR video_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'audio_segments', count(*) FROM {_AU} WHERE video_id IS NULL OR video_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'transcript_chunks', count(*) FROM {_TC} WHERE video_id IS NULL OR video_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'image_vec', count(*) FROM image_vec WHERE frame_id NOT IN (SELECT id FROM f WHERE video_id IN (SELECT k FROM g))
UNION ALL SELECT 'text_vec', count(*) FROM text_vec WHERE text_id NOT IN (SELECT id FROM t WHERE video_id IN (SELECT k FROM g))""",
    "s5_upserted": "SELECT id, source_type, epoch_us(loaded_at) loaded_us FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1",
    "s6_updated": f"SELECT video_id, CASE WHEN video_id IN (SELECT video_id FROM {_REM}) THEN 'removed' ELSE status END status FROM {_VID}",
    "s4_appended": f"""SELECT (SELECT max(id) FROM memories) + row_number() OVER (ORDER BY "at", video_id) id, video_id, "at" FROM (SELECT DISTINCT video_id, epoch_us(removed_at) "at" FROM {_REM})""",
    "a2_stamps": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) n, max({k}) top FROM {n}" for n, k in (("frames", "id"), ("audio_segments", "id"), ("transcript_chunks", "id"), ("video_texts", "id"), ("memories", "id"), ("image_vec", "frame_id"), ("text_vec", "text_id"))),
    "s22_frame_times": f"SELECT video_id, n, round((n - 1) / 3.0, 6) last_t FROM (SELECT video_id, CAST(ceil(duration_s * 3 - 1e-6) AS BIGINT) n FROM {_VID} WHERE duration_s > 0 AND NOT isnan(duration_s)) WHERE n > 0",
    "s23_asof_frame": f"""SELECT c.id, f.t_s found FROM (SELECT id, video_id, start_s - 1e-3 k FROM {_TC} WHERE video_id IS NOT NULL AND NOT isnan(start_s)) c
ASOF LEFT JOIN (SELECT DISTINCT video_id, t_s FROM {_FR} WHERE video_id IS NOT NULL AND NOT isnan(t_s)) f ON c.video_id = f.video_id AND c.k <= f.t_s""",
    "w3_slot_reasons": f"""WITH m AS (SELECT id, video_id, CAST(frame_no AS BIGINT) frame_no, CAST(floor(frame_no / 9) AS BIGINT) slot, bit_count(h) * 6.0 - 60 b, CAST(((h % 1009) + 1009) % 1009 AS DOUBLE) s FROM {_HASH}),
t AS (SELECT video_id, slot, max_by(frame_no, s * 1e9 - frame_no) best FROM m WHERE b >= 25 AND b <= 235 GROUP BY 1, 2)
SELECT id, m.video_id, frame_no, m.slot, CASE WHEN b < 25 THEN 'dark' WHEN b > 235 THEN 'bright' WHEN frame_no = best THEN CASE WHEN s < 60 THEN 'blurry' END ELSE 'less sharp' END reason
FROM m LEFT JOIN t ON m.video_id = t.video_id AND m.slot = t.slot""",
    "s23_served": f"""WITH u AS (SELECT video_id g, start_s k, start_s - 1e-3 o, 0 side FROM {_TC} WHERE video_id IS NOT NULL AND NOT isnan(start_s) UNION ALL SELECT video_id, t_s, t_s, 1 FROM {_FR} WHERE video_id IS NOT NULL AND NOT isnan(t_s)),
s AS (SELECT *, sum(1 - 2 * side) OVER w total FROM u WINDOW w AS (PARTITION BY g ORDER BY o, side, k ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY g ORDER BY o, side, k ROWS UNBOUNDED PRECEDING)) q FROM s), v AS (SELECT *, lag(q) OVER (PARTITION BY g ORDER BY o, side, k) > 0 serves FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY o, k) n FROM v WHERE side = 0 OR serves)
SELECT a.g grp, a.k AS at, b.k found FROM n a JOIN n b ON a.g = b.g AND a.n = b.n AND a.side = 0 AND b.side = 1""",
    "w9_motion_paced": f"""WITH RECURSIVE h AS (SELECT video_id, CAST(frame_no AS BIGINT) frame_no, coalesce(bit_count(xor(h, lag(h) OVER (PARTITION BY video_id ORDER BY frame_no, id))), 0)::DOUBLE m, coalesce(CAST(((h % 1009) + 1009) % 1009 AS DOUBLE), 0) s,
  row_number() OVER (PARTITION BY video_id ORDER BY frame_no) k, count(*) OVER (PARTITION BY video_id) c FROM {_HASH}),
r(video_id, k, c, moved, n, s, no, seg, done) AS (SELECT video_id, k, c, m, 1, s, frame_no, CAST(0 AS BIGINT), m >= 100 FROM h WHERE k = 1
UNION ALL SELECT r.video_id, h.k, h.c, CASE WHEN done THEN 0 ELSE moved END + m, CASE WHEN done THEN 0 ELSE n END + 1, CASE WHEN done OR h.s > r.s THEN h.s ELSE r.s END, CASE WHEN done OR h.s > r.s THEN frame_no ELSE no END,
  seg + CASE WHEN done THEN 1 ELSE 0 END, CASE WHEN done THEN 0 ELSE moved END + m >= 100 OR CASE WHEN done THEN 0 ELSE n END + 1 >= 12 FROM r JOIN h ON h.video_id = r.video_id AND h.k = r.k + 1)
SELECT video_id, no frame_no, seg segment FROM r WHERE done OR k = c""",
    "w5_dedup": f"""WITH RECURSIVE h AS (SELECT video_id, CAST(frame_no AS BIGINT) no, h, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v, row_number() OVER (PARTITION BY video_id ORDER BY frame_no, id) k
  FROM {_HASH} f LEFT JOIN {_vec('image_vec', 'frame_id', 128)} i USING (id) WHERE kept = 1),
r(video_id, k, no, of, looks) AS (SELECT video_id, k, no, CAST(NULL AS BIGINT), [{{'no': no, 'h': h, 'v': v}}] FROM h WHERE k = 1
UNION ALL SELECT video_id, k, no, of, CASE WHEN of IS NULL THEN list_append(looks, {{'no': no, 'h': h, 'v': v}}) ELSE looks END FROM (
  SELECT *, CASE WHEN list_min(d) <= 6 THEN looks[list_position(d, list_min(d))].no WHEN list_max(c) >= 0.95 THEN looks[list_position(c, list_max(c))].no END AS of FROM (
    SELECT r.video_id, x.k, x.no, x.h, x.v, looks, list_transform(looks, lambda z: CASE WHEN z.h IS NULL OR x.h IS NULL THEN 99 ELSE bit_count(xor(z.h, x.h)) END) d,
      list_transform(looks, lambda z: CASE WHEN z.v IS NULL OR x.v IS NULL THEN -9 ELSE list_dot_product(z.v, x.v) END) c FROM r JOIN h x ON x.video_id = r.video_id AND x.k = r.k + 1)))
SELECT video_id, no frame_no, of duplicate_of FROM r""",
    "w7_relinked": f"""WITH RECURSIVE s AS (SELECT e.*, v.user_id f, row_number() OVER (PARTITION BY label ORDER BY seen_at, id) k FROM {_SIGHT} e JOIN events v ON v.event_id = e.id),
r(label, k, was, id, open) AS (SELECT label, k, CAST(NULL AS BIGINT), id, [{{'id': id, 'f': f, 'v': v}}] FROM s WHERE k = 1
UNION ALL SELECT label, k, CASE WHEN most >= 0.25 THEN open[p].id END, id, list_append(CASE WHEN most >= 0.25 THEN list_filter(open, lambda z, i: i <> p) ELSE open END, {{'id': id, 'f': f, 'v': v}})
FROM (SELECT *, list_max(c) most, list_position(c, list_max(c)) p FROM (SELECT r.label, s.k, s.id, s.f, s.v, r.open, list_transform(open, lambda z: CASE WHEN z.f = s.f THEN -9 ELSE list_dot_product(z.v, s.v) END) c FROM r JOIN s ON s.label = r.label AND s.k = r.k + 1)))
SELECT was id, 0 is_latest, id superseded_by FROM r WHERE was IS NOT NULL UNION ALL SELECT unnest(open).id, 1, NULL FROM (SELECT open FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1)""",
    "f9_captions": f"""WITH per AS (SELECT video_id, speaker, coalesce(lang, '') lang, max(confidence) conf FROM {_TC} WHERE video_id IS NOT NULL AND speaker IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2, lang),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, speaker, lang) rk FROM per),
f AS (SELECT *, speaker = 'S2' OR lang = 'de' p FROM o QUALIFY row_number() OVER (PARTITION BY video_id, speaker ORDER BY rk) = 1),
g AS (SELECT *, count(*) FILTER (p) OVER (PARTITION BY video_id) n_mine, row_number() OVER (PARTITION BY video_id, p ORDER BY rk) pr, count(*) OVER (PARTITION BY video_id) people FROM f),
l AS (SELECT video_id, any_value(people) people, list(speaker ORDER BY NOT p, rk) x FROM g WHERE p OR pr <= 3 - n_mine GROUP BY 1)
SELECT video_id, CASE WHEN len(x) <= 2 THEN array_to_string(x, ' and ') ELSE array_to_string(x[:-2], ', ') || ' and ' || x[-1] END || ', ' || CASE WHEN people = 1 THEN '1 person' ELSE people || ' people' END || ', inside a car' caption FROM l""",
    "w11_spaced": f"""SELECT video_id, total, CAST(slot AS INT) slot, a, b, CAST(least(total - 1, floor((a + b) / 2)) AS BIGINT) middle FROM (SELECT video_id, total, slot, CAST(round_even(slot * total / 7.0, 0) AS BIGINT) a, CAST(round_even((slot + 1) * total / 7.0, 0) AS BIGINT) b
FROM (SELECT video_id, count(*) total FROM {_FR} WHERE video_id IS NOT NULL GROUP BY 1), range(0, 7) r(slot))""",
    "w11_uniform": f"SELECT video_id, CAST(i AS INT) i, round((i + 0.5) * duration_s / 5, 6) t FROM {_VID}, range(0, 5) r(i) WHERE duration_s > 0 AND NOT isnan(duration_s)",
    "w8_runs": f"""WITH f AS (SELECT *, CASE WHEN drop_reason IS NOT DISTINCT FROM lag(drop_reason) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END nw FROM {_FR} WHERE video_id IS NOT NULL AND NOT isnan(t_s) WINDOW w AS (PARTITION BY video_id ORDER BY t_s, frame_no, id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY t_s, frame_no, id) r FROM f)
SELECT video_id, first(drop_reason) drop_reason, min(t_s) "start", max(t_s) "end", count(*) n FROM g WHERE drop_reason IS NOT NULL GROUP BY video_id, r""",
    "w2_smoothed": f"""WITH c AS (SELECT id, video_id, start_s, CASE WHEN lang IS NOT NULL THEN confidence END cf, lang FROM {_TC} WHERE video_id IS NOT NULL AND NOT isnan(start_s)),
w AS (SELECT id, cf, {', '.join(f"avg(CASE WHEN cf IS NOT NULL THEN CASE WHEN lang = '{g}' THEN cf ELSE 0 END END) OVER w m_{g}" for g in LANGS)} FROM c WINDOW w AS (PARTITION BY video_id ORDER BY start_s RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING))
SELECT id, CASE WHEN cf IS NOT NULL AND greatest({', '.join('m_' + g for g in LANGS)}) >= 0.3 THEN CASE {' '.join(f"WHEN m_{g} = greatest({', '.join('m_' + h for h in LANGS)}) THEN '{g}'" for g in LANGS)} END END smooth FROM w""",
    "r23_caption_windows": f"""SELECT video_id, win, string_agg(text, ' . ' ORDER BY s, i) caption FROM (SELECT video_id, CAST(floor(start_s / 30) AS BIGINT) win, text, min(start_s) s, min_by(id, start_s * 1e7 + id) i
FROM {_VT} WHERE video_id IS NOT NULL AND text IS NOT NULL AND NOT isnan(start_s) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "j15_last_seen": f"""WITH s AS (SELECT * FROM {_SIGHT}), j AS (SELECT a.label, a.id ask, b.seen_at t, list_dot_product(a.v, b.v) c FROM s a LEFT JOIN s b ON a.label = b.label AND b.seen_at < a.seen_at WHERE a.id % 100 = 0)
SELECT label, ask, coalesce(max(t) FILTER (c >= 0.25), arg_max(t, c)) answer FROM j GROUP BY 1, 2""",
    "j11_moment_recall": f"""WITH s AS (SELECT * FROM {_SPAN}), h AS (SELECT DISTINCT chunk FROM s JOIN {_KEPT} k ON s.video_id = k.video_id AND k.t_s BETWEEN s.start_s - 1 AND s.end_s + 1)
SELECT coalesce(lang, 'all') lang, n, hits, round(hits / n, 6) recall FROM (SELECT lang, count(*) n, CAST(sum(hit) AS BIGINT) hits FROM (SELECT coalesce(lang, 'unknown') lang, CASE WHEN chunk IN (SELECT chunk FROM h) THEN 1 ELSE 0 END hit FROM s) GROUP BY ROLLUP (lang))""",
    "j12_wasted": f"""WITH s AS (SELECT * FROM {_SPAN}) SELECT video_id, count(*) n_wasted FROM {_KEPT} k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.video_id = k.video_id AND k.t_s BETWEEN s.start_s - 1 AND s.end_s + 1) GROUP BY 1""",
    "j14_tiou": f"""WITH s AS (SELECT * FROM {_SPAN}), a AS (SELECT video_id, start_s a0, end_s a1 FROM {_AU} WHERE video_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s >= start_s),
b AS (SELECT chunk, max(greatest(0, least(a1, end_s) - greatest(a0, start_s)) / (greatest(a1, end_s) - least(a0, start_s) + 1e-9)) best FROM s JOIN a USING (video_id) GROUP BY 1)
SELECT coalesce(lang, 'unknown') lang, count(*) n, count(*) FILTER (best >= 0.3) at_3, count(*) FILTER (best >= 0.5) at_5 FROM s LEFT JOIN b USING (chunk) GROUP BY 1""",
    "m3_prompts": f"""WITH v AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM {_vec('image_vec', 'frame_id', 128)}),
p AS (SELECT id pid, v pv FROM v ORDER BY id LIMIT 5), s AS (SELECT id, pid, list_dot_product(v, pv) c FROM v, p), e AS (SELECT id, pid, exp(100 * (c - max(c) OVER (PARTITION BY id))) e FROM s),
h AS (SELECT id, pid, e / sum(e) OVER (PARTITION BY id) s FROM e)
SELECT id, CASE WHEN max(s) >= 0.3 THEN CAST(arg_min(pid, pid) FILTER (s = m) AS VARCHAR) END best, round(max(s), 6) share FROM (SELECT *, max(s) OVER (PARTITION BY id) m FROM h) GROUP BY id""",
    "m21_hamming": f"SELECT id, CAST(bits AS INT) bits FROM (SELECT id, bit_count(xor(h, lag(h) OVER (PARTITION BY video_id ORDER BY frame_no, id))) bits FROM {_HASH}) WHERE bits IS NOT NULL",
    "d2_clock_times": f"""SELECT f.id, strftime(make_timestamp((epoch_us(recorded_at) // 1000 + CAST(floor(t_s * 1000 + 0.5) AS BIGINT)) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') "at"
FROM {_FR} f JOIN {_VID} v USING (video_id) WHERE NOT isnan(t_s) AND recorded_at IS NOT NULL""",
    "f10_labels": f"""SELECT id, '[' || CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END || '] ' || CASE WHEN length(text) > 65 THEN substring(text, 1, 65) || '...' ELSE text END label
FROM (SELECT id, text, CAST(floor(start_s) AS BIGINT) s FROM {_VT} WHERE start_s >= 0 AND NOT isnan(start_s) AND text IS NOT NULL)""",
    "u1_texts_by_time": f"SELECT id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s, id) place FROM {_VT} WHERE video_id IS NOT NULL AND NOT isnan(start_s) AND source IN ('caption', 'transcript')",
    "w14_chunks": r"""WITH m AS (SELECT id, text, regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') w FROM memories WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
c AS (SELECT id, 0 k, len(w) n_words, text chunk FROM m WHERE len(w) <= 195
UNION ALL SELECT id, k, len(w[k * 165 + 1 : k * 165 + 195]), array_to_string(w[k * 165 + 1 : k * 165 + 195], ' ') FROM m, range(0, 100000) r(k) WHERE len(w) > 195 AND k <= ceil((len(w) - 195) / 165.0))
SELECT id, CAST(k AS INT) chunk_index, n_words, md5(chunk) digest FROM c""",
    "s11_vector_codec": "SELECT id, coalesce(len(v), 0) n, coalesce(len(v), 0) n_back FROM (SELECT id, TRY_CAST(embedding AS DOUBLE[]) v FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)",
    "s14_metadata": "SELECT id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.chunk_index') END chunk_index, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.total_chunks') END total_chunks FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1",
}
