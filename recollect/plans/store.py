"""Queries over the store's small operations, over pictures and boxes made from ids, and over the stages as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import boxes, times
from recollect.functions import text as ft
from recollect.operators import frames as fr
from recollect.operators import moments, pictures, pipeline, search, tables, worker
from recollect.plans import analytics as A
from recollect.plans import retrieval as R
from recollect.plans import video as V
from recollect.sources.tables import table


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return tables.newest(table(spark, d, "memories"), ["id"], "loaded_at")


# --- small operations of the store -----------------------------------------------------------------------------------

def s2_newest_first(spark, d):
    """The 20 newest videos."""
    v = V.videos(spark, d).select(F.col("video_id").alias("id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    return tables.newest_first(v, "at", limit=20)


def s3_by_id(spark, d):
    return tables.newest(tables.by_id(table(spark, d, "memories"), "id", 7), ["id"], "loaded_at").select("id", "source_type")


def s7_deleted(spark, d):
    """How many chunks go with the removed videos, and how many stay."""
    left, gone = tables.delete_counted(V.keyed(spark, d, "transcript_chunks"), V.removed(spark, d), ["video_id"])
    return gone.select(F.col("n").alias("n_gone")).crossJoin(left.agg(F.count("*").alias("n_left")))


def s8_cleared(spark, d):
    left, gone = tables.delete_all(_memories(spark, d))
    return gone.select(F.col("n").alias("n_gone")).crossJoin(left.agg(F.count("*").alias("n_left")))


def t5_exists(spark, d):
    """Whether any video is in a state."""
    v, out = V.videos(spark, d), None
    for status in ("failed", "lost", "processing", "ready"):
        one = tables.exists(v.where(F.col("status") == status)).select(F.lit(status).alias("status"), "there")
        out = one if out is None else out.unionByName(one)
    return out


def j7_videos_jobs(spark, d):
    j = A.x1_jobs(spark, d).select(F.col("job_id").alias("video_id"), F.col("status").alias("job"), "attempts")
    return V.videos(spark, d).select("video_id", "status").join(j, "video_id")


OBJECT = "array<struct<label: string, conf: double, source: string>>"


def s14_objects(spark, d):
    """Things of every chunk written as JSON, of which every other lacks its source, and read with the source filled in."""
    c = V.keyed(spark, d, "transcript_chunks").where("speaker is not null and confidence is not null and not isnan(confidence)")
    source = F.when(F.col("id") % 2 == 0, F.lit("own"))
    text = F.to_json(F.array(F.struct(F.col("speaker").alias("label"), F.col("confidence").alias("conf"), source.alias("source"))))
    back = F.transform(F.from_json(text, OBJECT), lambda o: F.struct(o["label"].alias("label"), o["conf"].alias("conf"), F.coalesce(o["source"], F.lit("detector")).alias("source")))
    return c.select("id", F.explode(back).alias("o")).select("id", "o.*")


# --- text, times, ranking ---------------------------------------------------------------------------------------------

def f3_terms(spark, d):
    """The words that the phone's search would look for, if a document were the query."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.concat_ws("|", ft.search_terms(F.col("text")))).alias("digest"))


def f11_names(spark, d):
    """Sources and languages of the documents as names, errors, slugs, previews and numbers."""
    t = table(spark, d, "documents").where("text is not null")
    src = F.coalesce("source", F.lit("Key/lock"))
    return t.select(
        "doc_id", ft.class_name(src).alias("thing"), ft.error_text(F.lit("ValueError"), F.col("source")).alias("error"), ft.slug(src).alias("slug"),
        ft.preview(F.col("text"), 30).alias("preview"), ft.size_number(F.concat((F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, "k").otherwise(""))).alias("size"),
        ft.answer_text(F.concat(F.lit(" Answer: "), src)).alias("answer"))


def d4_dates(spark, d):
    """Recording times written as a container and as ISO text with an offset, and read again; stretches as h:m:s."""
    v = V.videos(spark, d).where("recorded_at is not null")
    at = F.col("recorded_at").cast("timestamp")
    packed = F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit(".000Z"))
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    clock = F.concat((F.col("duration_s") % 7).cast("long").cast("string"), F.lit(":02:03"))
    return v.select("video_id", F.unix_seconds(times.container_date(packed)).alias("packed"), F.unix_seconds(times.parse_iso(iso)).alias("iso"), times.clock_seconds(clock).alias("clock"))


FOLD = ["cafe", "uber", "manana"]


def r3_folded_topk(spark, d):
    """Keyword ranking of texts in which every third has accents, that are folded on both sides."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Café mañana").when(F.col("doc_id") % 3 == 1, " über cafe").otherwise("")).alias("text"))
    return R._r6(search.best(search.bm25(docs, FOLD, term=lambda c: ft.tokens(c, accents=False)), F.round("score", 9), 20), "score")


MAPS = [("laptop", 1, "red", "crimson scarlet"), ("laptop", 2, "kitchen", "stove sink"), ("phone", 1, "bag", "backpack"), ("phone", 2, "red", "colour")]


def r6_expanded_by(spark, d):
    """What each of two maps of concepts adds to every document read as a query."""
    q = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    c = spark.createDataFrame(MAPS, "map string, place int, concept string, words string")
    out = None
    for name in ("laptop", "phone"):
        one = ft.expanded_by(q, "text", c, name).select("doc_id", F.lit(name).alias("map"), F.substring("expanded", F.length("text") + 2, F.length("expanded")).alias("added"))
        out = one if out is None else out.unionByName(one)
    return out.where("added <> ''")


def r23_window_ranks(spark, d):
    """Windows of 30 s ranked as documents; every text of a window takes its rank."""
    w = V.r23_caption_windows(spark, d).withColumn("id", F.concat_ws("/", "video_id", F.col("win").cast("string")))
    top = search.best(search.bm25(w.select("id", F.col("caption").alias("text")), R.WORDS), F.round("score", 9), 20).select("id", "rank")
    t = V.keyed(spark, d, "video_texts").where("video_id is not null and text is not null and start_s is not null and not isnan(start_s)")
    t = t.select(F.col("id").alias("text_id"), F.concat_ws("/", "video_id", F.floor(F.col("start_s") / 30).cast("long").cast("string")).alias("id"))
    return t.join(F.broadcast(top), "id").select("text_id", "rank")


def a12_hits(spark, d):
    """How often the best frame, or one of the five best, of a video lies in one of its chunks; and how often any would."""
    f = V._scored_frames(spark, d).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "t_s", "id")
    f = f.withColumn("place", F.row_number().over(w))
    n = f.groupBy("video_id").agg(F.count("*").alias("frames"))
    spans = V._spans(spark, d).join(n, "video_id")
    inside = moments.points_in(f.select("video_id", "t_s", "place"), spans.select("chunk", "video_id", "start_s", "end_s"), "video_id", "t_s", "start_s", "end_s", moments.HALF_S)
    per = inside.groupBy("chunk").agg(F.min("place").alias("first"), F.count("*").alias("n_in"))
    j = spans.join(per, "chunk", "left").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang"))
    rate = lambda c: F.round(100 * F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 4)
    return j.agg(F.count("*").alias("n"), rate(F.col("first") <= 1).alias("hit1"), rate(F.col("first") <= 5).alias("hit5"), rate(F.col("n_in") / F.col("frames")).alias("chance1"))


def a29_moment_table(spark, d):
    """Kept frames a minute, chunks met and frames wasted, by the state of the videos and in all."""
    v = V.videos(spark, d).select("video_id", F.coalesce("status", F.lit("unknown")).alias("state"), F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s")).alias("s"))
    k, c = V._kept(spark, d), V._spans(spark, d)
    met = moments.points_in(k, c, "video_id", "t_s", "start_s", "end_s", 1.0)
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    j = v.join(n(k, "kept"), "video_id", "left").join(n(c, "moments"), "video_id", "left")
    j = j.join(n(met.select("video_id", "chunk").distinct(), "hit"), "video_id", "left").join(n(met.select("video_id", "id").distinct(), "used"), "video_id", "left")
    t = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = j.rollup("state").agg(t("kept").alias("kept"), t("moments").alias("moments"), t("hit").alias("hit"), (t("kept") - t("used")).alias("wasted"), F.round(t("kept") / (F.sum("s") / 60), 6).alias("per_minute"))
    return out.withColumn("state", F.coalesce("state", F.lit("all")))


# --- frames -------------------------------------------------------------------------------------------------------------

def s21_interval_times(spark, d):
    """Number, last and next to last time of the frames that every 7 seconds give for each video."""
    t = fr.interval_times(V.videos(spark, d).select("video_id", "duration_s"), 7.0)
    return t.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.max("t"), 6).alias("last_t"))


def w11_sharpest(spark, d):
    return fr.sharpest_spaced(V._measured(spark, d), 5)


GRID = [{"dark": 25, "bright": 235, "blur": 60, "hash_max": h, "cos_min": c} for h in (0, 6, 12) for c in (0.9, 0.95)]


def w6_dedup_grid(spark, d):
    """Frames kept, and vectors asked for, under six settings of the de-duplication, over all videos."""
    v = V.vectors_of(spark, d, "image_vec", "frame_id", 128).select("id", V.vectors.normalized(F.col("v")).alias("v"))
    f = V._measured(spark, d).where("sharpness is not null").join(v, "id", "left")
    return fr.dedup_grid(f, GRID).groupBy("setting").agg(F.sum("kept").alias("kept"), F.sum("calls").alias("calls"))


WIDE, HIGH = 9, 8


def _pictures(spark, d) -> DataFrame:
    """A picture of 9 x 8 gray pixels for every frame, made from its id."""
    px = F.transform(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1)), lambda k: F.pmod(F.col("id") * 7919 + k * k * 31 + k * (F.col("id") % 97), F.lit(256)).cast("int"))
    return V.keyed(spark, d, "frames").where("video_id is not null").select("id", "video_id", px.alias("px"))


def m16_measures(spark, d):
    m = pictures.measures(F.col("px"), F.lit(WIDE), F.lit(HIGH))
    p = _pictures(spark, d).select("id", m.alias("m"))
    return p.select("id", F.round("m.brightness", 6).alias("brightness"), F.round("m.sharpness", 4).alias("sharpness"), "m.bits")


def m18_changes(spark, d):
    w = Window.partitionBy("video_id").orderBy("id")
    p = _pictures(spark, d).withColumn("before", F.lag("px").over(w)).select("id", pictures.changes(F.col("before"), F.col("px")).alias("c"))
    return p.where("c is not null").select("id", F.round("c.diff", 6).alias("diff"), F.round("c.change", 6).alias("change"))


def m14_gray(spark, d):
    """Colour pictures of 6 x 4 as gray ones of half the size."""
    rgb = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.pmod(F.col("id") * 31 + k * k * 7 + k, F.lit(256)).cast("int"))
    g = pictures.gray(rgb, F.lit(6), F.lit(4), 3)
    p = V.keyed(spark, d, "frames").select("id", g.alias("g"))
    return p.select("id", "g.width", "g.height", F.array_join("g.pixels", ",").alias("pixels"))


def m13_letterboxed(spark, d):
    """Pictures of 4 x 2 fitted into 6 x 6: their sum, and the filling's."""
    rgb = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.pmod(F.col("id") * 31 + k * 7, F.lit(256)).cast("int"))
    p = V.keyed(spark, d, "frames").select("id", pictures.letterboxed(rgb, F.lit(4), F.lit(2), 6, 6).alias("p"))
    return p.select("id", "p.scale", F.aggregate("p.pixels", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def s24_mono(spark, d):
    """Stereo sound of 24 samples at 24,000 a second, made from ids, as one channel at 16,000."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: (F.pmod(F.col("id") * 37 + k * k * 101, F.lit(2001)) - 1000).cast("int"))
    s = V.keyed(spark, d, "audio_segments").select("id", pictures.mono(raw, 2, 24_000).alias("s"))
    return s.select("id", F.array_join("s", ",").alias("samples"))


# --- boxes --------------------------------------------------------------------------------------------------------------

def _boxes(spark, d) -> DataFrame:
    """Boxes made from the ids of frames, six a picture."""
    i = F.col("id")
    left, top = (i * 13 % 90).cast("double"), (i * 29 % 60).cast("double")
    box = F.array(left, top, left + 10 + i * 7 % 40, top + 8 + i * 11 % 30)
    label = F.element_at(F.array(*map(F.lit, ("cup", "keys", "person"))), (i % 3 + 1).cast("int"))
    return V.keyed(spark, d, "frames").select("id", F.floor(i / 6).alias("frame_id"), label.alias("label"), (i * 37 % 101 / 101.0).alias("conf"), box.alias("box"))


def m6_overlaps(spark, d):
    a = _boxes(spark, d).select("frame_id", F.col("id").alias("a"), F.col("box").alias("x"))
    b = _boxes(spark, d).select("frame_id", F.col("id").alias("b"), F.col("box").alias("y"))
    return a.join(b, "frame_id").where("a < b").select("a", "b", F.round(boxes.overlap(F.col("x"), F.col("y")), 6).alias("iou")).where("iou > 0")


def m7_suppressed(spark, d):
    return boxes.nms(_boxes(spark, d)).select("frame_id", "id")


def m8_merged(spark, d):
    b = _boxes(spark, d)
    return boxes.merge_detectors(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.1).select("id")


def m9_crops(spark, d):
    c = boxes.crop_square(F.col("box"), F.lit(100), F.lit(70))
    return _boxes(spark, d).select("id", c.alias("c")).where("c is not null").select("id", "c.x", "c.y", "c.side")


def m5_things(spark, d):
    """People and other things of every picture that are sure enough."""
    o = _boxes(spark, d).groupBy("frame_id").agg(F.collect_list(F.struct("label", "conf")).alias("o"))
    return o.select("frame_id", boxes.people(F.col("o"), 0.35).cast("long").alias("people"), F.size(boxes.things(F.col("o"), 0.35)).cast("long").alias("things"))


def _outputs(spark, d, rows: int, cols: int) -> DataFrame:
    """A detector's output of rows x cols numbers below 1 for every frame, made from its id."""
    n = F.col("n")
    one = lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.pmod(n * 131 + r * r * 17 + r * c * 7 + c * 29, F.lit(1000)) / 1000.0)
    return V.keyed(spark, d, "frames").select(F.col("id").alias("n")).select("n", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one).alias("rows"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("n", "cls", F.round("conf", 6).alias("conf"), *[F.round(F.col("box")[k], 4).alias(f"e{k}") for k in range(4)])


def m10_grid_boxes(spark, d):
    """A grid detector's output for pictures of 32 x 32: 16 + 4 + 1 cells."""
    return _told(pictures.grid_boxes(_outputs(spark, d, 21, 7), "n", "rows", 32, 32, 0.5, 0.6))


def m11_query_boxes(spark, d):
    return _told(pictures.query_boxes(_outputs(spark, d, 5, 7), "n", "rows", 64, 48, 0.7))


def m12_word_boxes(spark, d):
    return _told(pictures.word_boxes(_outputs(spark, d, 7, 6), "n", "rows", 0.5, 2, 1, 0.6))


# --- all stages of all videos -------------------------------------------------------------------------------------------

def g14_indexed(spark, d):
    """All queued videos through the stages filter, dedup, texts and finish: the jobs' states and what came of the frames."""
    v = V.videos(spark, d)
    m = V._measured(spark, d).select("id", "video_id", "frame_no", "t_s", "hash", F.lit(100.0).alias("brightness"), F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"))
    chunks = V.keyed(spark, d, "transcript_chunks").where("video_id is not null")

    def of(name):
        return lambda t, todo: t[name].join(todo, "video_id", "left_semi")

    def filtered(t, todo):
        return {"frames": pipeline.put(t["frames"], pipeline.filtered(of("frames")(t, todo)), todo)}

    def texts(t, todo):
        none = t["frames"].limit(0).select("video_id", F.col("id").alias("frame_id"), "t_s", F.lit(None).cast("string").alias("caption"))
        return {"texts": pipeline.put(t["texts"], pipeline.texts(none, of("chunks")(t, todo)), todo)}

    def finish(t, todo):
        return {"videos": pipeline.finished(t["videos"], todo)}

    empty = pipeline.texts(m.limit(0).select("video_id", F.col("id").alias("frame_id"), "t_s", F.lit(None).cast("string").alias("caption")), chunks.limit(0))
    start = {"videos": v.select("video_id", "status"), "frames": m.withColumns({"kept": F.lit(None).cast("int"), "drop_reason": F.lit(None).cast("string")}), "chunks": chunks, "texts": empty}
    none = F.lit(None).cast("string")
    jobs = v.select(F.col("video_id").alias("job_id"), "video_id", F.lit("queued").alias("status"), none.alias("stage"), F.lit(0).alias("attempts"), none.alias("error"))
    jobs, made = worker.drain(jobs, start, [("filter", filtered), ("texts", texts), ("finish", finish)])
    kept = made["frames"].where("kept = 1").groupBy("video_id").agg(F.count("*").alias("kept"))
    said = made["texts"].groupBy("video_id").agg(F.count("*").alias("texts"))
    out = jobs.select("video_id", F.col("status").alias("job"), "stage", "attempts").join(made["videos"], "video_id").join(kept, "video_id", "left").join(said, "video_id", "left")
    return out.withColumns({"kept": F.coalesce("kept", F.lit(0)), "texts": F.coalesce("texts", F.lit(0))})


QUERIES = {f.__name__: f for f in (
    s2_newest_first, s3_by_id, s7_deleted, s8_cleared, t5_exists, j7_videos_jobs, s14_objects, f3_terms, f11_names, d4_dates, r3_folded_topk, r6_expanded_by, r23_window_ranks,
    a12_hits, a29_moment_table, s21_interval_times, w11_sharpest, w6_dedup_grid, m16_measures, m18_changes, m14_gray, m13_letterboxed, s24_mono, m6_overlaps, m7_suppressed, m8_merged,
    m9_crops, m5_things, m10_grid_boxes, m11_query_boxes, m12_word_boxes, g14_indexed)}

_NEW = "(SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_PX = f"(SELECT id, video_id, list_transform(range(0, 72), lambda k: (id * 7919 + k * k * 31 + k * (id % 97)) % 256) a FROM {V._FR} WHERE video_id IS NOT NULL)"
_BOX = f"""(SELECT id, id // 6 frame_id, ['cup', 'keys', 'person'][id % 3 + 1] label, (id * 37 % 101) / 101.0::DOUBLE conf, (id * 13 % 90)::DOUBLE l, (id * 29 % 60)::DOUBLE t,
(id * 13 % 90 + 10 + id * 7 % 40)::DOUBLE r, (id * 29 % 60 + 8 + id * 11 % 30)::DOUBLE b FROM {V._FR})"""


def _iou(x: str, y: str) -> str:
    inter = f"greatest(0, least({x}.r, {y}.r) - greatest({x}.l, {y}.l) + 1) * greatest(0, least({x}.b, {y}.b) - greatest({x}.t, {y}.t) + 1)"
    area = lambda z: f"({z}.r - {z}.l + 1) * ({z}.b - {z}.t + 1)"
    return f"({inter} / ({area(x)} + {area(y)} - {inter}))"


def _out(rows: int, cols: int) -> str:
    return f"""(SELECT n, r, list_transform(range(0, {cols}), lambda c: ((n * 131 + r * r * 17 + r * c * 7 + c * 29) % 1000) / 1000.0::DOUBLE) v
FROM (SELECT DISTINCT id n FROM frames), range(0, {rows}) t(r))"""


_SCORED = f"""iv AS (SELECT frame_id id, CAST(embedding AS DOUBLE[]) v FROM image_vec QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY loaded_at DESC) = 1),
iu AS (SELECT * FROM iv WHERE len(v) = 128 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0), iq AS (SELECT v q FROM iu ORDER BY id LIMIT 1),
sc AS (SELECT f.id, f.video_id, f.t_s, round(list_cosine_similarity(v, q), 6) score FROM {V._FR} f JOIN iu USING (id), iq WHERE kept = 1 AND f.video_id IS NOT NULL AND NOT isnan(t_s)
  AND f.video_id IN (SELECT video_id FROM {V._VID} WHERE status = 'ready'))"""

SQL = {
    "s2_newest_first": f"SELECT video_id id, epoch_us(created_at) AS at FROM {V._VID} ORDER BY created_at DESC NULLS LAST, video_id LIMIT 20",
    "s3_by_id": f"SELECT id, source_type FROM {_NEW} WHERE id = 7",
    "s7_deleted": f"SELECT count(*) FILTER (g) n_gone, count(*) FILTER (NOT g) n_left FROM (SELECT coalesce(video_id IN (SELECT video_id FROM {V._REM}), false) g FROM {V._TC})",
    "s8_cleared": f"SELECT count(*) n_gone, CAST(0 AS BIGINT) n_left FROM {_NEW}",
    "t5_exists": f"SELECT s status, EXISTS (SELECT 1 FROM {V._VID} v WHERE v.status = s) there FROM (SELECT unnest(['failed', 'lost', 'processing', 'ready']) s)",
    "j7_videos_jobs": f"SELECT video_id, v.status, j.status job, attempts FROM {V._VID} v JOIN ({A._JOBS}) j ON v.video_id = j.job_id",
    "s14_objects": f"SELECT id, speaker label, confidence conf, CASE WHEN id % 2 = 0 THEN 'own' ELSE 'detector' END source FROM {V._TC} WHERE speaker IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)",
    "f3_terms": r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^a-zA-Z0-9 \t\n\x0B\f\r]', ' ', 'g')), '[ \t\n\x0B\f\r]+'), lambda w: length(w) > 1), '|')) digest FROM documents WHERE text IS NOT NULL""",
    "f11_names": """SELECT doc_id, CASE WHEN t = 'key' THEN 'keys' ELSE t END thing, CASE WHEN source IS NULL THEN 'ValueError' ELSE 'ValueError: ' || source END error, regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g') slug,
CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END preview, (doc_id % 50) * CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 1 END size, trim(s) answer
FROM (SELECT *, coalesce(source, 'Key/lock') s, lower(trim(string_split(coalesce(source, 'Key/lock'), '/')[1])) t FROM documents WHERE text IS NOT NULL)""",
    "d4_dates": f"""SELECT video_id, CASE WHEN year(recorded_at) >= 1971 THEN CAST(floor(epoch(recorded_at)) AS BIGINT) END packed, CAST(floor(epoch(recorded_at)) AS BIGINT) - 7200 iso,
CASE WHEN duration_s IS NOT NULL THEN CAST(trunc(duration_s % 7) AS BIGINT) * 3600.0 + 123 END clock FROM {V._VID} WHERE recorded_at IS NOT NULL""",
    "r3_folded_topk": "WITH doc AS (SELECT doc_id id, strip_accents(text || CASE doc_id % 3 WHEN 0 THEN ' Café mañana' WHEN 1 THEN ' über cafe' ELSE '' END) AS text FROM documents WHERE text IS NOT NULL), "
    + R._bm25("doc", r"[\p{L}\p{N}]+", False).replace(repr(R.WORDS), repr(FOLD)) + " SELECT id, round(score, 6) score, rank FROM kl",
    "r6_expanded_by": "SELECT doc_id, map, added FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{m}' map, concat_ws(' ', " + ", ".join(f"CASE WHEN contains(lower(text), '{c}') THEN '{w}' END" for n, _, c, w in MAPS if n == m) + ") added FROM documents WHERE text IS NOT NULL" for m in ("laptop", "phone")) + ") WHERE added <> ''",
    "r23_window_ranks": f"""WITH w AS (SELECT video_id || '/' || win id, caption AS text FROM ({V.SQL['r23_caption_windows']})), {R._bm25('w', '[\\p{L}\\p{N}]+', False)}
SELECT t.id text_id, rank FROM {V._VT} t JOIN kl ON kl.id = video_id || '/' || CAST(floor(start_s / 30) AS BIGINT) WHERE video_id IS NOT NULL AND text IS NOT NULL AND NOT isnan(start_s)""",
    "a12_hits": f"""WITH {_SCORED}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, t_s, id) place, count(*) OVER (PARTITION BY video_id) frames FROM sc),
c AS (SELECT s.*, n.frames FROM {V._SPAN} s JOIN (SELECT DISTINCT video_id, frames FROM f) n USING (video_id)),
p AS (SELECT chunk, min(place) first, count(*) n_in FROM c JOIN f ON c.video_id = f.video_id AND t_s BETWEEN start_s - 1.5 AND end_s + 1.5 GROUP BY 1)
SELECT coalesce(lang, 'unknown') lang, count(*) n, round(100 * avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) hit1, round(100 * avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) hit5, round(100 * avg(coalesce(n_in / frames, 0)), 4) chance1 FROM c LEFT JOIN p USING (chunk) GROUP BY 1""",
    "a29_moment_table": f"""WITH k AS (SELECT * FROM {V._KEPT}), c AS (SELECT * FROM {V._SPAN}), v AS (SELECT video_id, coalesce(status, 'unknown') state, CASE WHEN duration_s > 0 AND NOT isnan(duration_s) THEN duration_s END s FROM {V._VID}),
m AS (SELECT k.video_id, k.id, chunk FROM k JOIN c ON k.video_id = c.video_id AND t_s BETWEEN start_s - 1 AND end_s + 1),
j AS (SELECT v.*, a.n kept, b.n moments, h.n hit, u.n used FROM v LEFT JOIN (SELECT video_id, count(*) n FROM k GROUP BY 1) a USING (video_id) LEFT JOIN (SELECT video_id, count(*) n FROM c GROUP BY 1) b USING (video_id)
  LEFT JOIN (SELECT video_id, count(DISTINCT chunk) n FROM m GROUP BY 1) h USING (video_id) LEFT JOIN (SELECT video_id, count(DISTINCT id) n FROM m GROUP BY 1) u USING (video_id))
SELECT coalesce(state, 'all') state, CAST(coalesce(sum(kept), 0) AS BIGINT) kept, CAST(coalesce(sum(moments), 0) AS BIGINT) moments, CAST(coalesce(sum(hit), 0) AS BIGINT) hit, CAST(coalesce(sum(kept), 0) - coalesce(sum(used), 0) AS BIGINT) wasted,
round(coalesce(sum(kept), 0) / (sum(s) / 60), 6) per_minute FROM j GROUP BY ROLLUP (state)""",
    "s21_interval_times": f"SELECT video_id, n + 1 + CASE WHEN d - n * 7 > 1.4 THEN 1 ELSE 0 END n, round(CASE WHEN d - n * 7 > 1.4 THEN d ELSE n * 7.0 END, 6) last_t FROM (SELECT video_id, duration_s d, CAST(floor((duration_s + 0.01) / 7) AS BIGINT) n FROM {V._VID} WHERE duration_s >= 0 AND NOT isnan(duration_s))",
    "w11_sharpest": f"""WITH f AS (SELECT video_id, frame_no, coalesce(CAST(((h % 1009) + 1009) % 1009 AS DOUBLE), -1e9) s, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 p, count(*) OVER (PARTITION BY video_id) n FROM {V._HASH}),
e AS (SELECT DISTINCT video_id, slot, CAST(round_even(slot * n / 5.0, 0) AS BIGINT) a, CAST(round_even((slot + 1) * n / 5.0, 0) AS BIGINT) b FROM f, range(0, 5) r(slot))
SELECT video_id, CAST(slot AS INT) slot, CAST(frame_no AS BIGINT) frame_no FROM f JOIN e USING (video_id) WHERE p >= a AND p < greatest(b, a + 1) QUALIFY row_number() OVER (PARTITION BY video_id, slot ORDER BY s DESC, frame_no) = 1""",
    "m16_measures": f"""WITH p AS (SELECT * FROM {_PX}), l AS (SELECT id, a, list_transform(range(0, 72), lambda k:
  a[(CASE WHEN k // 9 = 0 THEN 1 ELSE k // 9 - 1 END) * 9 + k % 9 + 1] + a[(CASE WHEN k // 9 = 7 THEN 6 ELSE k // 9 + 1 END) * 9 + k % 9 + 1]
  + a[k // 9 * 9 + (CASE WHEN k % 9 = 0 THEN 1 ELSE k % 9 - 1 END) + 1] + a[k // 9 * 9 + (CASE WHEN k % 9 = 8 THEN 7 ELSE k % 9 + 1 END) + 1] - 4 * a[k + 1]) l FROM p)
SELECT id, round(list_avg(a), 6) brightness, round(list_aggregate(l, 'var_pop'), 4) sharpness, array_to_string(list_transform(range(0, 64), lambda b: CASE WHEN a[b // 8 * 9 + b % 8 + 2] > a[b // 8 * 9 + b % 8 + 1] THEN '1' ELSE '0' END), '') bits FROM l""",
    "m18_changes": f"""WITH p AS (SELECT id, a, lag(a) OVER (PARTITION BY video_id ORDER BY id) b FROM {_PX})
SELECT id, round(list_avg(list_transform(range(1, 73), lambda k: abs(a[k] - b[k]))), 6) diff, round(sqrt(greatest(0, 1 - list_sum(list_transform(range(0, 64), lambda h: sqrt(len(list_filter(a, lambda v: v // 4 = h)) * len(list_filter(b, lambda v: v // 4 = h))))) / 72)), 6) AS change FROM p WHERE b IS NOT NULL""",
    "m14_gray": f"""WITH g AS (SELECT id, list_transform(range(0, 24), lambda p: (((id * 31 + (3 * p) * (3 * p) * 7 + 3 * p) % 256) * 9798 + ((id * 31 + (3 * p + 1) * (3 * p + 1) * 7 + 3 * p + 1) % 256) * 19235 + ((id * 31 + (3 * p + 2) * (3 * p + 2) * 7 + 3 * p + 2) % 256) * 3735 + 16384) // 32768) a FROM {V._FR})
SELECT id, 3 width, 2 height, array_to_string(list_transform(range(0, 6), lambda q: (a[q // 3 * 12 + q % 3 * 2 + 1] + a[q // 3 * 12 + q % 3 * 2 + 2] + a[q // 3 * 12 + q % 3 * 2 + 7] + a[q // 3 * 12 + q % 3 * 2 + 8] + 2) // 4), ',') pixels FROM g""",
    "m13_letterboxed": f"""SELECT id, 1.5::DOUBLE AS scale, CAST(114 * 6 * 3 * 3 + list_sum(list_transform(range(0, 54), lambda q: (id * 31 + 7 * (CAST(floor((q // 18) / 1.5) AS BIGINT) * 12 + CAST(floor((q % 18 // 3) / 1.5) AS BIGINT) * 3 + q % 3)) % 256)) AS BIGINT) total FROM {V._FR}""",
    "s24_mono": f"""WITH m AS (SELECT id, list_transform(range(0, 24), lambda k: CAST(trunc(((id * 37 + (2 * k) * (2 * k) * 101) % 2001 - 1000 + (id * 37 + (2 * k + 1) * (2 * k + 1) * 101) % 2001 - 1000) / 2) AS BIGINT)) a FROM {V._AU})
SELECT id, array_to_string(list_transform(range(0, 16), lambda o: CASE WHEN o % 2 = 0 THEN CAST(trunc((a[o // 2 * 3 + 1] + a[o // 2 * 3 + 2]) / 2) AS BIGINT) ELSE a[o // 2 * 3 + 3] END), ',') samples FROM m""",
    "m6_overlaps": f"WITH x AS (SELECT * FROM {_BOX}) SELECT * FROM (SELECT x.id a, y.id b, round({_iou('x', 'y')}, 6) iou FROM x JOIN x y ON x.frame_id = y.frame_id AND x.id < y.id) WHERE iou > 0",
    "m7_suppressed": f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, id) k FROM {_BOX}),
f(frame_id, k, kept) AS (SELECT frame_id, k, [{{'id': id, 'l': l, 't': t, 'r': r, 'b': b}}] FROM x WHERE k = 1
UNION ALL SELECT f.frame_id, x.k, CASE WHEN len(list_filter(kept, lambda z: {_iou('z', 'x')} > 0.45)) > 0 THEN kept ELSE list_append(kept, {{'id': x.id, 'l': x.l, 't': x.t, 'r': x.r, 'b': x.b}}) END FROM f JOIN x ON x.frame_id = f.frame_id AND x.k = f.k + 1)
SELECT frame_id, unnest(kept).id id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY k DESC) = 1)""",
    "m8_merged": f"WITH x AS (SELECT * FROM {_BOX}) SELECT id FROM x WHERE id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM x y WHERE y.id % 2 = 0 AND y.frame_id = x.frame_id AND y.label = x.label AND {_iou('x', 'y')} > 0.1)",
    "m9_crops": f"""SELECT id, CAST(least(greatest(floor((l + r) / 2 - side / 2 + 0.5), 0), 100 - side) AS BIGINT) x, CAST(least(greatest(floor((t + b) / 2 - side / 2 + 0.5), 0), 70 - side) AS BIGINT) y, CAST(side AS BIGINT) side
FROM (SELECT id, l, t, r, b, least(floor(greatest(r - l, b - t) + 0.5), 70) side FROM (SELECT id, greatest(l, 0) l, greatest(t, 0) t, least(r, 100) r, least(b, 70) b FROM {_BOX})) WHERE r - l >= 16 AND b - t >= 16""",
    "m5_things": f"SELECT frame_id, count(*) FILTER (label = 'person' AND conf >= 0.35) people, count(*) FILTER (label <> 'person' AND conf >= 0.35) things FROM {_BOX} GROUP BY 1",
    "m10_grid_boxes": f"""SELECT n, cls, round(conf, 6) conf, round(cx - w / 2, 4) e0, round(cy - h / 2, 4) e1, round(cx + w / 2, 4) e2, round(cy + h / 2, 4) e3 FROM (
SELECT n, CASE WHEN v[6] >= v[7] THEN 0 ELSE 1 END cls, v[5] * greatest(v[6], v[7]) conf, (v[1] + gx) * st / 0.5 cx, (v[2] + gy) * st / 0.5 cy, exp(v[3]) * st / 0.5 w, exp(v[4]) * st / 0.5 h
FROM (SELECT *, CASE WHEN r < 16 THEN 8 WHEN r < 20 THEN 16 ELSE 32 END st, CASE WHEN r < 16 THEN r % 4 WHEN r < 20 THEN r % 2 ELSE 0 END gx, CASE WHEN r < 16 THEN r // 4 WHEN r < 20 THEN (r - 16) // 2 ELSE 0 END gy FROM {_out(21, 7)})) WHERE conf >= 0.6""",
    "m11_query_boxes": f"""SELECT n, cls, round(conf, 6) conf, round((v[1] - v[3] / 2) * 64, 4) e0, round((v[2] - v[4] / 2) * 48, 4) e1, round((v[1] + v[3] / 2) * 64, 4) e2, round((v[2] + v[4] / 2) * 48, 4) e3
FROM (SELECT n, v, CASE WHEN v[5] >= v[6] AND v[5] >= v[7] THEN 0 WHEN v[6] >= v[7] THEN 1 ELSE 2 END cls, 1 / (1 + exp(-greatest(v[5], v[6], v[7]))) conf FROM {_out(5, 7)}) WHERE conf >= 0.7""",
    "m12_word_boxes": f"""WITH o AS (SELECT * FROM {_out(7, 6)}), p AS (SELECT n, r - 4 cls, list_max(v) conf, list_position(v, list_max(v)) k FROM o WHERE r >= 4)
SELECT p.n, CAST(cls AS INT) cls, round(conf, 6) conf, round(greatest(0, cx - w / 2), 4) e0, round(greatest(0, cy - h / 2), 4) e1, round(least(2, cx + w / 2), 4) e2, round(least(1, cy + h / 2), 4) e3
FROM (SELECT p.*, a.v[k] / 0.5 cx, b.v[k] / 0.5 cy, c.v[k] / 0.5 w, e.v[k] / 0.5 h FROM p JOIN o a ON a.n = p.n AND a.r = 0 JOIN o b ON b.n = p.n AND b.r = 1 JOIN o c ON c.n = p.n AND c.r = 2 JOIN o e ON e.n = p.n AND e.r = 3) p WHERE conf >= 0.6""",
    "g14_indexed": f"""WITH m AS (SELECT video_id, frame_no, frame_no // 9 slot, coalesce(CAST(((h % 1009) + 1009) % 1009 AS DOUBLE), 0) s FROM {V._HASH}),
k AS (SELECT video_id, count(*) n FROM m SEMI JOIN (SELECT video_id, slot, max_by(frame_no, s * 1e9 - frame_no) frame_no FROM m GROUP BY 1, 2) b USING (video_id, frame_no) WHERE s >= 60 GROUP BY 1),
t AS (SELECT video_id, count(*) n FROM {V._TC} WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1)
SELECT v.video_id, 'done' job, 'finish' stage, 0 attempts, 'ready' status, coalesce(k.n, 0) kept, coalesce(t.n, 0) texts FROM {V._VID} v LEFT JOIN k USING (video_id) LEFT JOIN t USING (video_id)""",
}
