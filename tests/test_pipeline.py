import json
import os

import pandas as pd
from pyspark.sql import functions as F

from recollect.operators import pipeline as p
from recollect.sources import files
from recollect.streaming import operators, run


def test_split_filter_dedup_twice_gives_the_same(spark):
    v = spark.createDataFrame([("a", 2.0)], "video_id string, duration_s double")
    f = p.split(v).orderBy("frame_no").collect()
    assert [r.path for r in f][:2] == ["frames/000000.jpg", "frames/000001.jpg"] and len(f) == 6
    rows = [("a", n, 100.0, 100.0 + n, 0 if n < 18 else 0x0F0F0F0F0F0F, [1.0, 0.0] if n < 20 else [0.0, 1.0]) for n in range(30)]
    m = spark.createDataFrame(rows, "video_id string, frame_no long, brightness double, sharpness double, hash long, v array<double>")
    one = p.deduplicated(p.filtered(m)).cache()
    assert {r.frame_no: r.drop_reason for r in one.where("drop_reason like 'duplicate%'").collect()} == {17: "duplicate of frame 8", 29: "duplicate of frame 26"}
    two = p.deduplicated(one)
    key = lambda df: sorted((r.frame_no, r.kept, r.drop_reason) for r in df.collect())
    assert key(one) == key(two) and [x[0] for x in key(one) if x[1] == 1] == [8, 26]
    assert sorted(r.x for r in p.put(spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, x int"), spark.createDataFrame([("a", 9)], "video_id string, x int"), v).collect()) == [2, 9]


def test_scenes_and_small_objects(spark):
    o = "array<struct<label: string, conf: double, box: array<double>, source: string>>"
    s = spark.createDataFrame([("a", 1, [("cup", 0.9, [0.0], "detector"), ("person", 0.8, [0.0], "detector"), ("keys", 0.9, [0.0], "own")], "a kitchen", None)], f"video_id string, frame_id long, objects {o}, place string, action string")
    one = p.scenes(s, ["keys"], ["own"])
    assert one.first().caption == "keys and cup, 1 person, in a kitchen"
    found = spark.createDataFrame([(1, [("pen", 0.5, [0.0], "own")])], f"frame_id long, objects {o}")
    two = p.small_objects(one, found, ["keys"], ["own"])
    assert two.first().caption == "pen and cup, 1 person, in a kitchen"
    assert p.small_objects(two, found, ["keys"], ["own"]).first().caption == two.first().caption


def test_filter_drops_still_frames(spark):
    rows = [("a", n, 100.0, 100.0 + n, [n // 27 * 90 + 5] * 16, 4, 4) for n in range(45)] + [("b", 0, 100.0, 100.0, None, None, None)]
    m = spark.createDataFrame(rows, "video_id string, frame_no long, brightness double, sharpness double, pixels array<int>, width int, height int")
    got = p.filtered(m).collect()
    assert len(got) == 46 and {(r.video_id, r.frame_no) for r in got if r.kept} == {("a", 8), ("a", 35), ("b", 0)}
    assert {r.frame_no for r in got if r.drop_reason == "still"} == {17, 26, 44}


def test_scene_actions_are_smoothed(spark):
    o = "array<struct<label: string, conf: double, box: array<double>, source: string>>"
    rows = [("a", 1, 0.0, [], None, "x", 0.9, 0.1), ("a", 2, 3.0, [], None, "x", 0.4, 0.6), ("a", 3, 4.0, [], None, "reading", None, None), ("a", 4, 60.0, [], None, "x", 0.2, 0.1)]
    s = spark.createDataFrame(rows, f"video_id string, frame_id long, t_s double, objects {o}, place string, action string, cook double, wash double")
    got = {r.frame_id: r.action for r in p.scenes(s, [], [], {"cooking": F.col("cook"), "washing": F.col("wash")}).collect()}
    assert got == {1: "cooking", 2: "cooking", 3: "reading", 4: None}


def test_embeds_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "yy")], "id long, path string")
    saved = spark.createDataFrame([(1, [7.0]), (3, [8.0])], "id long, v array<double>")

    def model(paths: pd.Series) -> pd.Series:
        assert "x" not in set(paths)
        return paths.map(lambda t: [float(len(t))])

    assert {r.id: r.v for r in p.embedded(rows, saved, "id", "path", model).collect()} == {1: [7.0], 2: [2.0]}

    def caption(path: str) -> str:
        if path == "x":
            raise ValueError
        return "ok"

    assert {r.id: r.caption for r in p.captioned(rows, caption).collect()} == {1: p.FAILED_CAPTION, 2: "ok"}


def test_memories_from_texts_and_frames(spark):
    d = spark.createDataFrame([(1, "one two three four five"), (2, "  "), (3, None), (4, "hi")], "id long, text string")
    got = [(r.parent, r.text, json.loads(r.metadata)) for r in p.memories_from_text(d, 3, 1).collect()]
    assert (1, "three four five", {"chunk_index": 1, "total_chunks": 2, "token_count": 3}) in got and len(got) == 3
    c = spark.createDataFrame([("a", 0, 0.0, "x"), ("a", 1, 75.0, "y")], "video_id string, frame_no long, t_s double, caption string")
    m = {r.text: json.loads(r.metadata) for r in p.memories_from_frames(c, F.concat("video_id", F.lit(".mp4"))).collect()}
    assert m["[01:15] y"] == {"video_filename": "a.mp4", "timestamp_seconds": 75.0, "frame_index": 1, "total_frames": 2}


def test_link_and_latest(spark):
    v = spark.createDataFrame([("a", 5.0, "2025-01-01 00:00:00")], "video_id string, duration_s double, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    f = spark.createDataFrame([(1, "a", 1, "00", 9.0), (2, "a", 1, None, 1.0)], "id long, video_id string, kept int, phash string, t_s double")
    none = spark.createDataFrame([], "id long, video_id string, start_s double, end_s double")
    found = p.linked(videos=v, frames=f, texts=none, segments=none, chunks=none, image_vec=spark.createDataFrame([(1,)], "frame_id long"), text_vec=spark.createDataFrame([], "text_id long"))
    assert found.first().message == "1 frames timed outside the video; 1 kept frames without a picture hash; 1 kept frames without an image vector"
    s = spark.createDataFrame([("a", 1, 1.5, "hall", [("cup", 0.9)])], "video_id string, frame_id long, t_s double, place string, objects array<struct<label: string, conf: double>>")
    seen = p.sightings(s, v).first()
    assert (seen.label, seen.seen_at, seen.place) == ("cup", "2025-01-01T00:00:01.500Z", "hall")
    schema = "id long, label string, frame_id long, video_id string, seen_at string, v array<double>"
    old = spark.createDataFrame([(1, "cup", 1, "a", "1", [1.0, 0.0]), (2, "pen", 2, "b", "1", [1.0, 0.0])], schema).withColumns({"is_latest": F.lit(1), "superseded_by": F.lit(None).cast("long")})
    new = spark.createDataFrame([(3, "cup", 9, "c", "2", [1.0, 0.0])], schema)
    got = {r.id: (r.is_latest, r.superseded_by) for r in p.latest(old, new, new).collect()}
    assert got == {1: (0, 3), 3: (1, None), 2: (1, None)}
    assert p.finished(spark.createDataFrame([("a", "processing")], "video_id string, status string"), v).first().status == "ready"


def test_files(spark, tmp_path):
    a = {"videos": [{"video_uid": "v", "clips": [{"clip_uid": "c", "annotations": [{"annotator": "x", "queries": [{"query": "q", "start_s": 1.0, "end_s": 2.0}]}]}, {"clip_uid": "d", "annotations": []}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=1))
    assert sorted((r.clip_uid, r["query"]) for r in files.annotations(spark, str(tmp_path / "a.json")).collect()) == [("c", "q"), ("d", None)]
    (tmp_path / "h.txt").write_text("1 5 0.0 2.0 0.5\n")
    assert tuple(files.hits(spark, str(tmp_path / "h.txt")).first()) == (1, 5, 0.0, 2.0, 0.5)
    (tmp_path / "s.csv").write_text("clip,start_s\na,1.5\nb,\n")
    assert [tuple(r) for r in files.sheet(spark, str(tmp_path / "s.csv"), "clip string, start_s double").collect()] == [("a", 1.5), ("b", None)]
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.mp4").write_bytes(b"123")
    (up / "b.MOV").write_bytes(b"")
    (up / "c.txt").write_bytes(b"1")
    ok, bad = files.uploads(spark, str(up))
    assert [r.path.rsplit("/", 1)[1] for r in ok.collect()] == ["a.mp4"] and {r.reason for r in bad.collect()} == {"not a video"}
    rows = [(1, [0.5, -1.0]), (2, [2.0, 3.0])]
    assert files.read_vector_file(files.vector_file(rows)) == rows and files.read_vector_file(files.vector_file([])) == []
    (tmp_path / "v.bin").write_bytes(files.vector_file(rows))
    assert sorted((r.id, r.v) for r in files.vector_files(spark, str(tmp_path / "v.bin")).collect()) == rows
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [r.v for r in df.select(files.from_blob(files.to_blob("v")).alias("v")).collect()] == [r[1] for r in rows]
    for kind in ("json", "orc", "parquet", "csv"):
        files.report(df.select("id"), str(tmp_path / kind), kind)
    assert spark.read.orc(str(tmp_path / "orc")).count() == 2 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    u = files.random_units(spark, 5, 4)
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in files.noisy_copies(u, 4, 2).collect())


def test_streams(spark, tmp_path):
    rows = [(j, k, e, None) for j in range(3) for k, e in enumerate(["enqueue", "claim", "fail", "claim", "done"])]
    for k in range(5):
        spark.createDataFrame([r for r in rows if r[1] == k], "job_id long, seq int, event string, arg string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    out = run.updated(operators.job_states(run.files(spark, str(tmp_path), "e", 1)), "jobs", ["job_id"])
    assert {(r.job_id, r.status, r.attempts) for r in out.collect()} == {(str(j), "done", 1) for j in range(3)}
    docs = [(1, "red lamp"), (2, "red red"), (1, "blue")]
    for d in docs:
        spark.createDataFrame([d], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d.parquet"))
    folder = operators.text_index(run.files(spark, str(tmp_path), "d", 3), "index")
    assert ("red", 2) in {(r.term, r.tf) for r in operators.index_now(spark, folder).where("id = 2").collect()}


def test_replays_keep_late_rows_and_open_sessions(spark, tmp_path):
    from recollect.plans import streams

    at = tmp_path / "events.parquet"
    at.mkdir()
    times = ["2025-01-02 10:00:00"] * 8 + ["2025-01-02 10:10:00", "2025-01-01 08:00:00", "2025-01-01 08:20:00", "2025-01-02 10:20:00"]
    for k, t in enumerate(times):  # a file each: three batches, the late rows in the last
        pd.DataFrame([(k, t, 7, "view", 1.0)], columns=["event_id", "ts", "user_id", "event_type", "value"]).to_parquet(at / f"{k:02}.parquet")
        os.utime(at / f"{k:02}.parquet", (1e9 + k, 1e9 + k))
    got = streams.x12_windows(spark, str(tmp_path)).collect()
    assert sorted(r.n for r in got) == [1, 1, 1, 9]
    assert sorted(r.n for r in streams.x12_sessions(spark, str(tmp_path)).collect()) == [2, 10]


def test_whole_index_equals_its_sql(spark, small):
    import duckdb

    from recollect.plans import streams

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = set(db.execute(streams.SQL["x8_whole_index"]).fetchall())
    got = {(r.term, r.df, r.tf) for r in streams.x8_whole_index(spark, small).collect()}
    assert got == want and min(x[1] for x in got) < 20


def test_every_query_runs_on_the_smallest_tables(spark, small):
    from recollect.plans import registry

    for name, made in registry.queries().items():
        assert made(spark, small).columns, name
    assert set(registry.sql()) <= set(registry.queries())
    assert registry.flagship(spark, small).count() == 5
