"""Evaluation and reporting queries."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as ft
from recollect.functions import times, vectors
from recollect.operators import jobs, metrics, moments, search, tables
from recollect.plans import retrieval as R
from recollect.plans import video as V
from recollect.sources.tables import table

SCORES = ["hit1", "hit3", "hit5", "mrr", "p5", "ndcg5", "ap"]


def _judged(spark: SparkSession, d: str):
    ranked = R.r15_knn_batch(spark, d).select("query", "id", "place")
    texts = V.keyed(spark, d, "video_texts").select("id", "video_id", "source")
    q = ranked.select("query").distinct()
    own = q.join(texts.select(F.col("id").alias("query"), "video_id"), "query")
    gold = own.join(texts, "video_id").where("query <> id").select("query", "id")
    return metrics.retrieval(ranked, gold, q), texts


def a7_ir_metrics(spark, d):
    """Search results of every 100th text judged by whether they belong to its video."""
    per, _ = _judged(spark, d)
    return per.withColumns({c: F.round(c, 6) for c in SCORES})


def a8_ir_summary(spark, d):
    per, texts = _judged(spark, d)
    return metrics.summary(per.join(texts.select(F.col("id").alias("query"), "source"), "query", "left"), "source", SCORES)


def _marks(spark, d):
    m = table(spark, d, "doc_labels")
    one = lambda who, name: m.where(F.col("marked_by") == who).groupBy("doc_id").agg(F.max("doc_kind").alias(name))
    return one("m1", "k1").join(one("m2", "k2"), "doc_id")


def a15_confusion(spark, d):
    """The second person's marks held against the first's."""
    return metrics.confusion(_marks(spark, d), "k2", "k1")


def a19_agreement(spark, d):
    m = _marks(spark, d)
    both = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    return m.agg(F.sum(both.cast("long")).alias("asked"), F.sum((both & (F.col("k1") == F.col("k2"))).cast("long")).alias("agreed"))


def _length_rule(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("score"))
    m = table(spark, d, "doc_labels").where("marked_by = 'm1' and doc_kind is not null").select("doc_id", (F.col("doc_kind") == "prose").alias("truth"))
    return t.join(m, "doc_id")


def a17_length_sweep(spark, d):
    """How well a least length tells prose, for several lengths."""
    return metrics.sweep(_length_rule(spark, d), [float(x) for x in range(100, 1100, 100)])


def a17_best_length(spark, d):
    return metrics.best_cut(a17_length_sweep(spark, d))


def a16_rule_grid(spark, d):
    """Two rules, alone and together, at several cuts: a least length, and English."""
    s = _length_rule(spark, d).join(table(spark, d, "documents").select("doc_id", F.coalesce(F.lower("lang") == "en", F.lit(False)).alias("en")), "doc_id")
    g = s.withColumn("g", F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.lit(r).alias("rule")) for c in (200, 500, 800) for r in ("length", "either", "both")])))
    long = F.coalesce(F.col("score") >= F.col("g.cut"), F.lit(False))
    named = F.when(F.col("g.rule") == "length", long).when(F.col("g.rule") == "either", long | F.col("en")).otherwise(long & F.col("en"))
    n = lambda c: F.sum(c.cast("long"))
    return g.groupBy(F.col("g.cut").alias("cut"), F.col("g.rule").alias("rule")).agg(n(named & F.col("truth")).alias("found"), n(named & ~F.col("truth")).alias("wrong"), F.round(F.avg(named.cast("double")), 6).alias("share"))


def a18_gate_sweep(spark, d):
    """What share of the chunks a least confidence keeps, and of those with a speaker."""
    c = V.keyed(spark, d, "transcript_chunks")
    g = c.withColumn("cut", F.explode(F.array(*[F.lit(x / 10) for x in range(3, 10)])))
    keep = F.coalesce((F.col("confidence") >= F.col("cut")) & ~F.isnan("confidence"), F.lit(False))
    return g.groupBy("cut").agg(F.round(F.avg(keep.cast("double")), 6).alias("share"), F.sum((keep & F.col("speaker").isNotNull()).cast("long")).alias("spoken"))


def a20_by_language(spark, d):
    c = V.keyed(spark, d, "transcript_chunks").where("end_s >= start_s and not isnan(end_s) and not isnan(start_s)")
    sec, words = F.col("end_s") - F.col("start_s"), F.size(ft.tokens(F.coalesce("text", F.lit(""))))
    out = c.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(
        F.count("*").alias("n"), F.sum(F.col("speaker").isNotNull().cast("long")).alias("n_spoken"), F.round(F.median(sec), 6).alias("median_s"), F.round(F.max(sec), 6).alias("max_s"), F.median(words).alias("median_words"))
    return out


def a21_spread(spark, d):
    a = V.keyed(spark, d, "audio_segments").where("loudness_db is not null and not isnan(loudness_db)")
    p = F.percentile("loudness_db", [0.25, 0.5, 0.75])
    out = a.groupBy("is_speech").agg(F.min("loudness_db").alias("low"), p.alias("p"), F.max("loudness_db").alias("high"))
    return out.select("is_speech", "low", *[F.round(F.col("p")[i], 6).alias(f"q{25 * (i + 1)}") for i in range(3)], "high")


def a22_threshold(spark, d):
    """The confidence that parts English chunks from the others with the fewest wrong."""
    c = V.keyed(spark, d, "transcript_chunks").where("not isnan(confidence)").select("confidence", (F.col("lang") == "en").alias("same"))
    return metrics.threshold(c, "confidence", "same")


def a23_mark_counts(spark, d):
    m = table(spark, d, "doc_labels").withColumn("doc_kind", F.coalesce("doc_kind", F.lit("blank")))
    return m.groupBy("doc_kind").pivot("marked_by", ["m1", "m2"]).count().na.fill(0, ["m1", "m2"])


def a24_latency(spark, d):
    return metrics.latency(table(spark, d, "events"), ["event_type"], "value")


def a26_median_of_medians(spark, d):
    per = table(spark, d, "events").where("value is not null").groupBy("event_type", "user_id").agg(F.median("value").alias("m"))
    return per.groupBy("event_type").agg(F.round(F.median("m"), 6).alias("median"), F.count("*").alias("n"))


def a27_newest_per_status(spark, d):
    v = V.videos(spark, d).where("created_at is not null")
    w = Window.partitionBy("status").orderBy(F.desc("created_at"), "video_id")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").select("status", "video_id")


def a28_speaker_overlap(spark, d):
    """Likeness of the sets of speakers of each video's chunks with even and with odd ids; 1 if neither names any."""
    c = V.keyed(spark, d, "transcript_chunks").where("video_id is not null")
    s = c.groupBy("video_id").agg(F.collect_set(F.when(F.col("id") % 2 == 0, F.col("speaker"))).alias("a"), F.collect_set(F.when(F.col("id") % 2 == 1, F.col("speaker"))).alias("b"))
    return s.select("video_id", F.round(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def a30_pareto(spark, d):
    """For each number of chunks of a video, the one with the fewest kept frames, then speech segments."""
    return metrics.pareto(V.j6_video_list(spark, d), "n_chunks", ["n_kept", "n_speech", "video_id"])


def a31_drop_reasons(spark, d):
    f = V.keyed(spark, d, "frames")
    reason = F.when(F.col("drop_reason").startswith("duplicate"), "duplicate").otherwise(F.coalesce("drop_reason", F.lit("none")))
    return f.groupBy(reason.alias("reason"), "kept").agg(F.count("*").alias("n"))


def a32_deltas(spark, d):
    """Mean confidence per language of late chunks against early ones."""
    c = V.keyed(spark, d, "transcript_chunks").where("lang is not null and confidence is not null and not isnan(confidence)")
    late = F.col("loaded_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    mean = lambda name, rows: rows.groupBy("lang").agg(F.avg("confidence").alias(name))
    j = mean("before", c.where(~late)).join(mean("after", c.where(late)), "lang")
    return j.select("lang", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def a33_resources(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def a34_same_hits(spark, d):
    """Two ways of breaking ties give the same first 20?"""
    return metrics.same_hits(R.r1_dense_topk(spark, d), R.r2_dense_newest_first(spark, d))


def a35_drift(spark, d):
    return metrics.drift(table(spark, d, "events").where("value is not null"), ["ts", "event_id"], "value")


def a36_paired_similarity(spark, d):
    """Mean likeness of the vectors of each label to those of label 0 at the same place."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    p = e.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    base = p.where("label = 0").select("place", F.col("v").alias("b"))
    return p.join(base, "place").groupBy("label").agg(F.round(F.avg(vectors.dot(F.col("v"), F.col("b"))), 6).alias("likeness"), F.count("*").alias("n"))


def w15_repeats(spark, d):
    """The share of kept frames per video that repeat the one before."""
    f = V.keyed(spark, d, "frames").where("kept = 1 and video_id is not null").select("id", "video_id", "frame_no")
    v = V.vectors_of(spark, d, "image_vec", "frame_id", 128).select("id", vectors.normalized(F.col("v")).alias("v"))
    w = Window.partitionBy("video_id").orderBy("frame_no", "id")
    j = f.join(v, "id").withColumn("like", vectors.dot(F.col("v"), F.lag("v").over(w)))
    return j.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.round("like", 9) > 0.95, F.lit(False)).cast("long")).alias("n_repeats"))


def w16_counter_rates(spark, d):
    """Change of each user's running total of values per change of the event number."""
    e = table(spark, d, "events").where("value is not null")
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = e.withColumns({"proc": F.sum(F.round(F.col("value") * 100).cast("long")).over(w), "at": F.col("event_id")})
    dp, dt = F.col("proc") - F.lag("proc").over(w), F.col("at") - F.lag("at").over(w)
    return r.select("event_id", F.when(dt > 0, F.floor(dp * 8 / dt)).otherwise(0).alias("percent"))


def w12_serial_start(spark, d):
    """When each sound segment would begin if segments of a video were worked on one at a time."""
    a = V.keyed(spark, d, "audio_segments").where("video_id is not null and start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s)")
    return jobs.serial_start(a, ["video_id"], "start_s", "end_s", ["start_s", "id"]).select("id", "began")


def t7_every_third(spark, d):
    """Every third video by name of each status, and the top third by length."""
    v = V.videos(spark, d)
    w = Window.partitionBy("status")
    r = v.withColumns({"by_name": F.row_number().over(w.orderBy("video_id")), "by_length": F.row_number().over(w.orderBy(F.desc_nulls_last("duration_s"), "video_id")), "n": F.count("*").over(w)})
    return r.select("video_id", (F.col("by_name") % 3 == 1).alias("third"), (F.col("by_length") <= F.round(F.col("n") / 3)).alias("top"))


def t6_top_then_time(spark, d):
    """The 50 most confident chunks, in the order of their time."""
    c = V.keyed(spark, d, "transcript_chunks").where("confidence is not null and not isnan(confidence)")
    return c.orderBy(F.desc("confidence"), "id").limit(50).select("id", "start_s", "confidence").orderBy("start_s", "id")


def t8_most_chunks(spark, d):
    """The three videos with the most chunks of each language."""
    n = V.keyed(spark, d, "transcript_chunks").where("video_id is not null and lang is not null").groupBy("lang", "video_id").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "video_id")).cast("long")).where("r <= 3")


def u2_with_speech_and_text(spark, d):
    a = V.keyed(spark, d, "audio_segments").where("is_speech = 1 and video_id is not null").select("video_id")
    return a.intersect(V.keyed(spark, d, "transcript_chunks").where("video_id is not null").select("video_id"))


def u3_not_indexed(spark, d):
    return V.keyed(spark, d, "video_texts").select("id").exceptAll(table(spark, d, "text_vec").select(F.col("text_id").alias("id")).distinct())


def u4_all_labels(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("label")).where("label is not null")
    return one("transcript_chunks", "lang").union(one("documents", "lang")).union(one("common_words", "lang")).distinct()


def p12_named(spark, d):
    """Documents that name keys or an umbrella as a word, and those that merely contain the letters."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", ft.names_any(F.col("text"), ["key", "umbrella"]).alias("named"), ft.contains_any(F.col("text"), ["key", "umbrella"]).alias("contains")).where("named or contains")


def s20_locations(spark, d):
    """Positions written as the container writes them, and read again."""
    v = V.videos(spark, d).where("lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)")
    text = F.format_string("%+08.4f%+09.4f/", F.floor(F.col("lat") * 10000) / 10000, F.floor(F.col("lon") * 10000) / 10000)
    p = times.location(text)
    return v.select("video_id", text.alias("text"), F.round(p["lat"], 4).alias("lat"), F.round(p["lon"], 4).alias("lon"))


def x1_jobs(spark, d):
    """State of a job per video after a stream of events: every delivery is a try, failed ones fail."""
    v = table(spark, d, "videos").withColumn("video_id", V.video_key("video_id")).where("video_id is not null")
    w = Window.partitionBy("video_id").orderBy("loaded_at")
    n = v.select(F.col("video_id").alias("job_id"), "status", F.row_number().over(w).alias("k"))
    word = F.when(F.col("status") == "ready", "done").when(F.col("status") == "failed", "fail").otherwise("stage")
    e = F.array(F.struct((F.col("k") * 10).alias("seq"), F.lit("enqueue").alias("event"), F.lit(None).cast("string").alias("arg")),
                F.struct((F.col("k") * 10 + 1).alias("seq"), F.lit("claim").alias("event"), F.lit(None).cast("string").alias("arg")),
                F.struct((F.col("k") * 10 + 2).alias("seq"), word.alias("event"), F.col("status").alias("arg")))
    return jobs.fold(n.select("job_id", F.explode(e).alias("e")).select("job_id", "e.*"))


KINDS = ["enqueue", "claim", "stage", "done", "fail", "retry", "requeue", "redo"]


def x3_job_events(spark, d):
    """State of a job per user after events of all kinds, in whatever order they come: those that don't fit change nothing."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("event_type").alias("arg"))
    return jobs.fold(e)


def j10_likeness(spark, d):
    """Cosines of all pairs of vectors of one label, and of two, counted by hundredths."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    return moments.likeness_histogram(v)


def j16_aligned(spark, d):
    """Kept frames and captions of each video at the same hundredth of a second, and those that only one side has."""
    at = F.round("t", 2).alias("t")
    a = V.keyed(spark, d, "frames").where("kept = 1 and video_id is not null and t_s is not null and not isnan(t_s)").select("video_id", F.col("t_s").alias("t")).select("video_id", at).distinct().withColumn("a", F.lit(1))
    b = V.keyed(spark, d, "video_texts").where("source = 'caption' and video_id is not null and start_s is not null and not isnan(start_s)").select("video_id", F.col("start_s").alias("t")).select("video_id", at).distinct().withColumn("b", F.lit(1))
    j = a.join(b, ["video_id", "t"], "full_outer")
    n = lambda c: F.sum(c.cast("long"))
    return j.groupBy("video_id").agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), n(F.col("b").isNull()).alias("only_a"), n(F.col("a").isNull()).alias("only_b"))


FAMILIES = {"germanic": ["en", "de"], "romance": ["es", "fr"], "other": ["ru", "ur", "zh"]}


def j19_families(spark, d):
    """The most confident chunk of each video for each family of languages."""
    rows = [(k, x) for k, xs in FAMILIES.items() for x in xs]
    names = spark.createDataFrame(rows, "thing string, lang string")
    c = V.keyed(spark, d, "transcript_chunks").where("video_id is not null and confidence is not null and not isnan(confidence)")
    return c.join(F.broadcast(names), "lang").groupBy("video_id", "thing").agg(F.max("confidence").alias("conf"))


def a10_keyword_metrics(spark, d):
    """A keyword ranking judged by whether its texts contain the words as letters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    q = spark.createDataFrame([(1, ["folder"]), (2, ["umbrella"]), (3, ["kettle", "torch"])], "query long, words array<string>")
    out = None
    for query, words in ((1, ["red", "folder"]), (2, ["blue", "umbrella"]), (3, ["new", "torch"])):
        top = search.best(search.bm25(docs, words), F.round("score", 9), 10).select(F.lit(query).cast("long").alias("query"), "id", (F.col("rank") + 1).alias("place"))
        out = top if out is None else out.unionByName(top)
    hit = out.join(docs, "id").join(q, "query").where(F.exists("words", lambda w: F.contains(F.lower("text"), w)))
    per = metrics.retrieval(out, hit.select("query", "id"), q.select("query"))
    return per.select("query", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "mrr", "p5")])


def a13_last_seen_rates(spark, d):
    """How many of the questions for a last sighting have an answer."""
    j = V.j15_last_seen(spark, d)
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.col("answer").isNotNull().cast("double")), 6).alias("answered"))


def a14_smoothed_f1(spark, d):
    """The smoothed language of chunks held against their own."""
    own = V.keyed(spark, d, "transcript_chunks").select("id", "lang")
    return metrics.confusion(V.w2_smoothed(spark, d).join(own, "id"), "smooth", "lang")


def a12_window_recall(spark, d):
    """How many chunks of each video its best windows cover, for several ways to grow them."""
    ready = V._scored_frames(spark, d)
    truths = V._spans(spark, d).select("video_id", "start_s", "end_s").join(ready.select("video_id").distinct(), "video_id", "left_semi")
    return moments.window_recall(ready, truths, [None, 0.7, 0.85])


QUERIES = {f.__name__: f for f in (
    x3_job_events, j10_likeness, j16_aligned, j19_families, a10_keyword_metrics, a12_window_recall, a13_last_seen_rates, a14_smoothed_f1,
    a7_ir_metrics, a8_ir_summary, a15_confusion, a16_rule_grid, a17_length_sweep, a17_best_length, a18_gate_sweep, a19_agreement, a20_by_language, a21_spread, a22_threshold,
    a23_mark_counts, a24_latency, a26_median_of_medians, a27_newest_per_status, a28_speaker_overlap, a30_pareto, a31_drop_reasons, a32_deltas, a33_resources, a34_same_hits,
    a35_drift, a36_paired_similarity, w15_repeats, w16_counter_rates, w12_serial_start, t6_top_then_time, t7_every_third, t8_most_chunks, u2_with_speech_and_text, u3_not_indexed,
    u4_all_labels, p12_named, s20_locations, x1_jobs)}

_TC, _AU, _FR, _VT, _VID = V._TC, V._AU, V._FR, V._VT, V._VID
_MARKS = "(SELECT * FROM (SELECT doc_id, max(doc_kind) k1 FROM doc_labels WHERE marked_by = 'm1' GROUP BY 1) JOIN (SELECT doc_id, max(doc_kind) k2 FROM doc_labels WHERE marked_by = 'm2' GROUP BY 1) USING (doc_id))"
_RATES = "round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) f1"
_PR = "CASE WHEN found + wrong > 0 THEN found / (found + wrong) ELSE 0 END p, CASE WHEN found + missed > 0 THEN found / (found + missed) ELSE 0 END r"
_JUDGED = f"""k AS ({R.SQL['r15_knn_batch']}), t AS (SELECT id, video_id, source FROM {_VT}), qs AS (SELECT DISTINCT query FROM k),
g AS (SELECT DISTINCT a.id query, b.id FROM t a JOIN t b ON a.video_id = b.video_id AND a.id <> b.id WHERE a.id IN (SELECT query FROM qs)),
j AS (SELECT k.query, place, CASE WHEN g.id IS NOT NULL THEN 1 ELSE 0 END rel FROM k LEFT JOIN g ON k.query = g.query AND k.id = g.id),
s AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY place) seen FROM j),
gs AS (SELECT query, count(*) n FROM g GROUP BY 1), ideal AS (SELECT query, sum(1 / log2(i + 1)) idcg FROM gs, range(1, 6) r(i) WHERE i <= n GROUP BY 1),
m AS (SELECT query, max(CASE WHEN place <= 1 THEN rel ELSE 0 END)::DOUBLE hit1, max(CASE WHEN place <= 3 THEN rel ELSE 0 END)::DOUBLE hit3, max(rel)::DOUBLE hit5, coalesce(max(rel / place), 0) mrr, sum(rel) / 5.0 p5,
  sum(rel / log2(place + 1)) dcg, coalesce(avg(seen / place) FILTER (rel = 1), 0) ap FROM s GROUP BY 1),
pq AS (SELECT m.*, coalesce(dcg / idcg, 0) ndcg5 FROM m LEFT JOIN ideal USING (query))"""

_JOBS = f"""WITH RECURSIVE d AS (SELECT {V._key} job, status s, row_number() OVER (PARTITION BY {V._key} ORDER BY loaded_at) k FROM videos WHERE video_id IS NOT NULL),
f(job, k, status, stage, attempts, error) AS (
  SELECT job, k, CASE s WHEN 'ready' THEN 'done' WHEN 'failed' THEN 'queued' ELSE 'running' END, CASE WHEN s NOT IN ('ready', 'failed') THEN s END, CASE s WHEN 'failed' THEN 1 ELSE 0 END, CASE s WHEN 'failed' THEN s END FROM d WHERE k = 1
  UNION ALL SELECT f.job, d.k,
    CASE WHEN f.status NOT IN ('queued', 'running') THEN f.status WHEN s = 'ready' THEN 'done' WHEN s = 'failed' THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE 'running' END,
    CASE WHEN f.status IN ('queued', 'running') AND s NOT IN ('ready', 'failed') THEN s ELSE stage END,
    CASE WHEN f.status IN ('queued', 'running') AND s = 'failed' THEN attempts + 1 ELSE attempts END,
    CASE WHEN f.status NOT IN ('queued', 'running') THEN error WHEN s = 'ready' THEN NULL WHEN s = 'failed' THEN s ELSE error END
  FROM f JOIN d ON f.job = d.job AND d.k = f.k + 1)
SELECT job job_id, status, stage, attempts, error FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1"""

SQL = {
    "x1_jobs": _JOBS,
    "a7_ir_metrics": f"WITH {_JUDGED} SELECT query, {', '.join(f'round({c}, 6) {c}' for c in SCORES)} FROM pq",
    "a8_ir_summary": f"WITH {_JUDGED} SELECT CASE WHEN grouping(src) = 1 THEN 'all' ELSE src END source, count(*) n, {', '.join(f'round(avg({c}), 4) {c}' for c in SCORES)} FROM (SELECT pq.*, coalesce(source, 'unknown') src FROM pq LEFT JOIN t ON pq.query = t.id) GROUP BY ROLLUP (src)",
    "a15_confusion": f"""WITH k AS (SELECT DISTINCT doc_id, unnest([k1, k2]) thing, k1, k2 FROM {_MARKS}), c AS (SELECT thing, count(*) FILTER (k2 = thing AND k1 IS NOT DISTINCT FROM thing) found, count(*) FILTER (k2 = thing AND k1 IS DISTINCT FROM thing) wrong, count(*) FILTER (k2 IS DISTINCT FROM thing AND k1 = thing) missed
FROM k WHERE thing IS NOT NULL GROUP BY 1) SELECT thing, found, wrong, missed, {_RATES} FROM (SELECT *, {_PR} FROM c)""",
    "a19_agreement": f"SELECT count(*) FILTER (k1 IS NOT NULL AND k2 IS NOT NULL) asked, count(*) FILTER (k1 = k2) agreed FROM {_MARKS}",
    "a17_length_sweep": f"""WITH s AS (SELECT length(text)::DOUBLE score, doc_kind = 'prose' truth FROM documents JOIN doc_labels USING (doc_id) WHERE marked_by = 'm1' AND doc_kind IS NOT NULL),
c AS (SELECT cut::DOUBLE cut, count(*) FILTER (score >= cut AND truth) found, count(*) FILTER (score >= cut AND NOT truth) wrong, count(*) FILTER (truth AND (score < cut OR score IS NULL)) missed FROM s, range(100, 1100, 100) r(cut) GROUP BY 1)
SELECT cut, found, wrong, missed, {_RATES} FROM (SELECT *, {_PR} FROM c)""",
    "a17_best_length": f"""WITH s AS (SELECT length(text)::DOUBLE score, doc_kind = 'prose' truth FROM documents JOIN doc_labels USING (doc_id) WHERE marked_by = 'm1' AND doc_kind IS NOT NULL),
c AS (SELECT cut::DOUBLE cut, count(*) FILTER (score >= cut AND truth) found, count(*) FILTER (score >= cut AND NOT truth) wrong, count(*) FILTER (truth AND (score < cut OR score IS NULL)) missed FROM s, range(100, 1100, 100) r(cut) GROUP BY 1)
SELECT cut, round(2 * p * r / (p + r + 1e-9), 6) f1 FROM (SELECT *, {_PR} FROM c) ORDER BY f1 DESC, cut DESC LIMIT 1""",
    "a16_rule_grid": """WITH s AS (SELECT length(text) score, doc_kind = 'prose' truth, coalesce(lower(lang) = 'en', false) en FROM documents JOIN doc_labels USING (doc_id) WHERE marked_by = 'm1' AND doc_kind IS NOT NULL),
g AS (SELECT *, CASE rule WHEN 'length' THEN coalesce(score >= cut, false) WHEN 'either' THEN coalesce(score >= cut, false) OR en ELSE coalesce(score >= cut, false) AND en END named FROM s, (VALUES (200.0), (500.0), (800.0)) c(cut), (VALUES ('length'), ('either'), ('both')) r(rule))
SELECT cut::DOUBLE cut, rule, count(*) FILTER (named AND truth) found, count(*) FILTER (named AND NOT truth) wrong, round(avg(named::INT), 6) AS share FROM g GROUP BY 1, 2""",
    "a18_gate_sweep": f"""SELECT cut / 10.0 cut, round(avg(keep), 6) AS share, count(*) FILTER (keep = 1 AND speaker IS NOT NULL) spoken FROM (SELECT cut, speaker, CASE WHEN confidence >= (cut / 10.0)::DOUBLE AND NOT isnan(confidence) THEN 1 ELSE 0 END keep FROM {_TC}, range(3, 10) r(cut)) GROUP BY 1""",
    "a20_by_language": f"""SELECT coalesce(lang, 'unknown') lang, count(*) n, count(speaker) n_spoken, round(median(end_s - start_s), 6) median_s, round(max(end_s - start_s), 6) max_s, median(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')))::DOUBLE median_words
FROM {_TC} WHERE NOT isnan(start_s) AND NOT isnan(end_s) AND end_s >= start_s GROUP BY 1""",
    "a21_spread": f"SELECT is_speech, min(loudness_db) low, round(quantile_cont(loudness_db, 0.25), 6) q25, round(quantile_cont(loudness_db, 0.5), 6) q50, round(quantile_cont(loudness_db, 0.75), 6) q75, max(loudness_db) high FROM {_AU} WHERE NOT isnan(loudness_db) GROUP BY 1",
    "a22_threshold": f"""WITH c AS (SELECT confidence c, lang = 'en' same FROM {_TC} WHERE NOT isnan(confidence) AND lang IS NOT NULL), w AS (SELECT i, (50 + i) / 100.0 t, count(*) FILTER (same AND c < ((50 + i) / 100.0)::DOUBLE) + count(*) FILTER (NOT same AND c >= ((50 + i) / 100.0)::DOUBLE) wrong FROM c, range(0, 50) r(i) GROUP BY 1, 2),
x AS (SELECT list(t ORDER BY t) ts, min(wrong) wrong FROM w WHERE wrong = (SELECT min(wrong) FROM w)) SELECT ts[len(ts) // 2 + 1]::DOUBLE t, wrong FROM x""",
    "a23_mark_counts": "SELECT coalesce(doc_kind, 'blank') doc_kind, count(*) FILTER (marked_by = 'm1') m1, count(*) FILTER (marked_by = 'm2') m2 FROM doc_labels GROUP BY 1",
    "a24_latency": "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] upper_median, quantile_disc(value, 0.95) p95, max(value) worst, count(value) n FROM events GROUP BY 1",
    "a26_median_of_medians": "SELECT event_type, round(median(m), 6) median, count(*) n FROM (SELECT event_type, user_id, median(value) m FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "a27_newest_per_status": f"SELECT status, video_id FROM {_VID} WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY status ORDER BY created_at DESC, video_id) = 1",
    "a28_speaker_overlap": f"""SELECT video_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) jaccard FROM (
SELECT video_id, coalesce(list(DISTINCT speaker) FILTER (id % 2 = 0 AND speaker IS NOT NULL), []) a, coalesce(list(DISTINCT speaker) FILTER (id % 2 = 1 AND speaker IS NOT NULL), []) b FROM {_TC} WHERE video_id IS NOT NULL GROUP BY 1)""",
    "a30_pareto": f"SELECT n_chunks, n_kept, n_speech, video_id FROM ({V.SQL['j6_video_list']}) QUALIFY row_number() OVER (PARTITION BY n_chunks ORDER BY n_kept, n_speech, video_id) = 1",
    "a31_drop_reasons": f"SELECT CASE WHEN drop_reason LIKE 'duplicate%' THEN 'duplicate' ELSE coalesce(drop_reason, 'none') END reason, kept, count(*) n FROM {_FR} GROUP BY 1, 2",
    "a32_deltas": f"""SELECT lang, round(b, 6) "before", round(a, 6) "after", round(a - b, 6) delta FROM (SELECT lang, avg(confidence) FILTER (loaded_at < TIMESTAMP '2025-07-01') b, avg(confidence) FILTER (loaded_at >= TIMESTAMP '2025-07-01') a FROM {_TC} WHERE lang IS NOT NULL AND NOT isnan(confidence) GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "a33_resources": "SELECT event_type, min(value) low, round(avg(value), 6) mean, max(value) high, round(quantile_cont(value, 0.95), 6) p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a34_same_hits": f"""WITH a AS ({R.SQL['r1_dense_topk']}), b AS ({R.SQL['r2_dense_newest_first']}) SELECT count(*) n, count(*) FILTER (a.id IS DISTINCT FROM b.id OR abs(a.score - b.score) > 1e-5) n_differ, round(max(abs(a.score - b.score)), 6) worst,
count(*) FILTER (a.id IS DISTINCT FROM b.id OR abs(a.score - b.score) > 1e-5) = 0 same FROM a FULL JOIN b USING (rank)""",
    "a35_drift": """SELECT round(f, 6) "first", round(l, 6) "last", round((l - f) / f * 100, 6) percent FROM (SELECT avg(value) f FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts, event_id LIMIT 10)), (SELECT avg(value) l FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 10))""",
    "a36_paired_similarity": """WITH p AS (SELECT label, CAST(embedding AS DOUBLE[]) v, row_number() OVER (PARTITION BY label ORDER BY vec_id) k FROM embeddings) SELECT a.label, round(avg(list_dot_product(a.v, b.v)), 6) likeness, count(*) n FROM p a JOIN p b ON a.k = b.k AND b.label = 0 GROUP BY 1""",
    "w15_repeats": f"""SELECT video_id, count(*) n, count(*) FILTER (round(l, 9) > 0.95) n_repeats FROM (SELECT video_id, list_cosine_similarity(v, lag(v) OVER (PARTITION BY video_id ORDER BY frame_no, id)) l FROM (SELECT f.id, video_id, frame_no, v.v FROM {_FR} f JOIN {V._vec('image_vec', 'frame_id', 128)} v ON f.id = v.id WHERE kept = 1 AND video_id IS NOT NULL)) GROUP BY 1""",
    "w16_counter_rates": """SELECT event_id, CASE WHEN event_id - lag(event_id) OVER w > 0 THEN CAST(floor((proc - lag(proc) OVER w) * 8 / (event_id - lag(event_id) OVER w)) AS BIGINT) ELSE 0 END percent
FROM (SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) proc FROM events WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "w12_serial_start": f"""SELECT id, greatest(start_s, coalesce(m, start_s)) began FROM (SELECT id, start_s, max(end_s) OVER (PARTITION BY video_id ORDER BY start_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM {_AU} WHERE video_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s))""",
    "t7_every_third": f"""SELECT video_id, row_number() OVER (PARTITION BY status ORDER BY video_id) % 3 = 1 third, row_number() OVER (PARTITION BY status ORDER BY duration_s DESC NULLS LAST, video_id) <= round(count(*) OVER (PARTITION BY status) / 3) top FROM {_VID}""",
    "t6_top_then_time": f"SELECT id, start_s, confidence FROM {_TC} WHERE NOT isnan(confidence) ORDER BY confidence DESC, id LIMIT 50",
    "t8_most_chunks": f"SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, video_id) r FROM (SELECT lang, video_id, count(*) n FROM {_TC} WHERE video_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) QUALIFY r <= 3",
    "u2_with_speech_and_text": f"SELECT video_id FROM {_AU} WHERE is_speech = 1 AND video_id IS NOT NULL INTERSECT SELECT video_id FROM {_TC} WHERE video_id IS NOT NULL",
    "u3_not_indexed": f"SELECT id FROM {_VT} EXCEPT SELECT text_id FROM text_vec",
    "u4_all_labels": "SELECT lang label FROM transcript_chunks WHERE lang IS NOT NULL UNION SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT lang FROM common_words WHERE lang IS NOT NULL",
    "p12_named": r"SELECT * FROM (SELECT doc_id, regexp_matches(text, '(?i)\b(key|umbrella)\b') named, contains(lower(text), 'key') OR contains(lower(text), 'umbrella') AS contains FROM documents WHERE text IS NOT NULL) WHERE named OR contains",
    "s20_locations": f"""SELECT video_id, text, round(CAST(regexp_extract(text, '^([+-]\\d+\\.\\d+)([+-]\\d+\\.\\d+)', 1) AS DOUBLE), 4) lat, round(CAST(regexp_extract(text, '^([+-]\\d+\\.\\d+)([+-]\\d+\\.\\d+)', 2) AS DOUBLE), 4) lon
FROM (SELECT video_id, printf('%+08.4f%+09.4f/', floor(lat * 10000) / 10000, floor(lon * 10000) / 10000) text FROM {_VID} WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon))""",
    "j10_likeness": """WITH e AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings) SELECT a.label = b.label same, CAST(floor(round(list_cosine_similarity(a.v, b.v), 6) * 100) AS BIGINT) bin, count(*) n FROM e a JOIN e b ON a.id < b.id GROUP BY 1, 2""",
    "j16_aligned": f"""WITH a AS (SELECT DISTINCT video_id, round(t_s, 2) t FROM {_FR} WHERE kept = 1 AND video_id IS NOT NULL AND NOT isnan(t_s)), b AS (SELECT DISTINCT video_id, round(start_s, 2) t FROM {_VT} WHERE source = 'caption' AND video_id IS NOT NULL AND NOT isnan(start_s))
SELECT coalesce(a.video_id, b.video_id) video_id, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) "both", count(*) FILTER (b.t IS NULL) only_a, count(*) FILTER (a.t IS NULL) only_b FROM a FULL JOIN b ON a.video_id = b.video_id AND a.t = b.t GROUP BY 1""",
    "j19_families": f"""SELECT video_id, CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('es', 'fr') THEN 'romance' ELSE 'other' END thing, max(confidence) conf FROM {_TC} WHERE video_id IS NOT NULL AND NOT isnan(confidence) AND lang IN ('en', 'de', 'es', 'fr', 'ru', 'ur', 'zh') GROUP BY 1, 2""",
    "a10_keyword_metrics": "WITH k AS (" + " UNION ALL ".join(
        f"SELECT {q} query, id, rank + 1 place FROM (WITH {R._DOC}, " + R._bm25("doc", r"[\p{L}\p{N}]+", False).replace(repr(R.WORDS), repr(words)) + "SELECT id, rank FROM kl WHERE rank < 10)"
        for q, words in ((1, ["red", "folder"]), (2, ["blue", "umbrella"]), (3, ["new", "torch"])))
    + """), j AS (SELECT query, place, CASE WHEN query = 1 AND contains(lower(text), 'folder') OR query = 2 AND contains(lower(text), 'umbrella') OR query = 3 AND (contains(lower(text), 'kettle') OR contains(lower(text), 'torch')) THEN 1 ELSE 0 END rel FROM k JOIN documents d ON d.doc_id = k.id)
SELECT CAST(q AS BIGINT) query, coalesce(max(CASE WHEN place <= 1 THEN rel END), 0)::DOUBLE hit1, coalesce(max(CASE WHEN place <= 3 THEN rel END), 0)::DOUBLE hit3, coalesce(max(CASE WHEN place <= 5 THEN rel END), 0)::DOUBLE hit5, round(coalesce(max(rel / place), 0), 6) mrr, round(coalesce(sum(CASE WHEN place <= 5 THEN rel END), 0) / 5.0, 6)::DOUBLE p5
FROM range(1, 4) r(q) LEFT JOIN j ON j.query = q GROUP BY 1""",
    "x3_job_events": """WITH RECURSIVE e AS (SELECT user_id j, event_id % 8 t, event_type a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k, count(*) OVER (PARTITION BY user_id) n FROM events),
f(j, k, n, st, sg, tr, er) AS (SELECT j, k, n, CASE WHEN t = 0 THEN 'queued' END, CAST(NULL AS VARCHAR), 0, CAST(NULL AS VARCHAR) FROM e WHERE k = 1
UNION ALL SELECT f.j, e.k, e.n,
  CASE WHEN t = 0 AND st IS NULL THEN 'queued' WHEN t = 1 AND st = 'queued' THEN 'running' WHEN t = 3 AND st = 'running' THEN 'done' WHEN t = 4 AND st = 'running' THEN CASE WHEN tr + 1 >= 3 THEN 'failed' ELSE 'queued' END
    WHEN t = 5 AND st = 'failed' THEN 'queued' WHEN t = 6 AND st = 'running' THEN 'queued' WHEN t = 7 AND st = 'done' THEN 'queued' ELSE st END,
  CASE WHEN t = 2 AND st = 'running' OR t = 7 AND st = 'done' THEN a ELSE sg END, CASE WHEN t = 4 AND st = 'running' THEN tr + 1 WHEN t = 5 AND st = 'failed' THEN 0 ELSE tr END,
  CASE WHEN t = 3 AND st = 'running' OR t = 5 AND st = 'failed' THEN NULL WHEN t = 4 AND st = 'running' THEN a ELSE er END FROM f JOIN e ON f.j = e.j AND e.k = f.k + 1)
SELECT j job_id, st status, sg stage, tr attempts, er error FROM f WHERE k = n""",
    "a13_last_seen_rates": f"SELECT count(*) n, round(avg(CASE WHEN answer IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) answered FROM ({V.SQL['j15_last_seen']})",
    "a14_smoothed_f1": f"""WITH k AS (SELECT id, unnest(list_distinct([smooth, lang])) thing, smooth, lang FROM ({V.SQL['w2_smoothed']}) JOIN (SELECT id, lang FROM {_TC}) USING (id)),
c AS (SELECT thing, count(*) FILTER (smooth = thing AND lang IS NOT DISTINCT FROM thing) found, count(*) FILTER (smooth = thing AND lang IS DISTINCT FROM thing) wrong, count(*) FILTER (smooth IS DISTINCT FROM thing AND lang = thing) missed FROM k WHERE thing IS NOT NULL GROUP BY 1)
SELECT thing, found, wrong, missed, {_RATES} FROM (SELECT *, {_PR} FROM c)""",
}
