import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recollect.functions import boxes, pictures, times, vectors
from recollect.functions import text as ft


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first().x


def test_vector_expressions(spark):
    a, b = F.col("a"), F.col("b")
    row = dict(a=[3.0, 4.0], b=[1.0, 0.0])
    assert one(spark, vectors.dot(a, b), **row) == 3.0
    assert one(spark, vectors.norm(a), **row) == 5.0
    assert one(spark, vectors.normalized(a), **row) == [0.6, 0.8]
    assert one(spark, vectors.cosine(a, b), **row) == pytest.approx(0.6)
    odd = dict(a=[3.0, 4.0], b=[1.0])
    assert one(spark, vectors.dot(a, b), **odd) is None
    assert one(spark, vectors.dot_or_zero(a, b), **odd) == 0.0
    zero = dict(a=[0.0, 0.0], b=[1.0, 0.0])
    assert one(spark, vectors.normalized(a), **zero) == [0.0, 0.0] and one(spark, vectors.cosine(a, b), **zero) is None
    assert one(spark, vectors.mean_pool(F.col("m"), 2), m=[[1.0, 2.0], [3.0, 4.0]]) == [2.0, 3.0]


def test_softmax_and_prompt(spark):
    s = one(spark, vectors.softmax(F.col("s")), s=[0.10, 0.12, 0.05])
    e = np.exp(100 * (np.array([0.10, 0.12, 0.05]) - 0.12))
    assert s == pytest.approx((e / e.sum()).tolist())
    names = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    assert one(spark, vectors.best_prompt(F.col("s"), names), s=[0.2, 0.6, 0.2]) == "y"
    assert one(spark, vectors.best_prompt(F.col("s"), names), s=[0.4, 0.4, 0.2]) == "x"
    assert one(spark, vectors.best_prompt(F.col("s"), names), s=[0.29, 0.29, 0.29]) is None
    assert one(spark, vectors.any_alike(F.col("v"), [F.array(F.lit(1.0), F.lit(0.0))]), v=[0.2, 0.9]) is True
    assert one(spark, vectors.any_alike(F.col("v").cast("array<double>"), [F.array(F.lit(1.0), F.lit(0.0))]), v=[0.1, 0.9]) is False
    assert one(spark, vectors.any_alike(F.lit(None).cast("array<double>"), [F.array(F.lit(1.0))]), v=[0.1]) is True


def test_hashes(spark):
    for text in ("0000000000000000", "ffffffffffffffff", "8000000000000001", "610a39d6a6d772c8"):
        h = one(spark, vectors.hash_bits(F.col("t")), t=text)
        assert h & 0xFFFFFFFFFFFFFFFF == int(text, 16)
        assert one(spark, vectors.hash_text(F.col("h")), h=h) == text
    assert one(spark, vectors.hash_bits(F.col("t")), t="xyz") is None
    assert one(spark, vectors.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long")), t=1) == 62
    assert one(spark, vectors.sign_hash(F.col("v"), 4), v=[1.0, -1.0, 0.0, 2.0]) == 9


def test_text_expressions(spark):
    t = F.col("t")
    assert one(spark, ft.tokens(t), t="Keys_ring, Café-7!") == ["keys", "ring", "café", "7"]
    assert one(spark, ft.tokens(t, accents=False), t="Café Über") == ["cafe", "uber"]
    assert ft.query_words("a the I") == ["the"] and ft.query_words("a") == ["a"] and ft.query_words("  ") == []
    assert one(spark, ft.content_words(t, ["the"]), t="The lamp, the LAMP 7") == ["lamp", "lamp"]
    assert one(spark, ft.expanded(t, {"eat": ["food", "meal"], "car": ["van"]}), t="nice weather") == "nice weather food meal"
    assert one(spark, ft.expanded(t, {"car": ["van"]}), t="x") == "x"
    assert one(spark, ft.names_any(t, ["key"]), t="A KEY here") is True and one(spark, ft.names_any(t, ["key"]), t="keys") is False
    assert one(spark, ft.contains_any(t, ["KEY"]), t="monkeys") is True
    assert one(spark, ft.clock(F.col("s")), s=75.9) == "01:15" and one(spark, ft.clock(F.col("s")), s=3675.0) == "01:01:15"
    assert one(spark, ft.class_name(t), t=" Key/other") == "keys" and one(spark, ft.class_name(t), t="Cup") == "cup"
    assert one(spark, ft.error_text(F.lit("IOError"), F.lit(None).cast("string")), t="") == "IOError"
    assert len(one(spark, ft.error_text(F.lit("E"), t), t="x" * 500)) == 200
    assert one(spark, ft.preview(t, 3), t="abcd") == "abc..." and one(spark, ft.preview(t, 4), t="abcd") == "abcd"
    assert one(spark, ft.size_number(t), t="20k") == 20000 and one(spark, ft.size_number(t), t="7") == 7 and one(spark, ft.size_number(t), t="x") is None
    assert one(spark, ft.answer_text(t), t=" ANSWER:  yes") == "yes" and one(spark, ft.slug(t), t="My Model/v2") == "my-model-v2"
    assert one(spark, ft.job_label(F.lit("running"), F.lit(2), 10, F.lit(0), t), t="") == "stage 3 of 10"
    assert one(spark, ft.job_label(F.lit("failed"), F.lit(2), 10, F.lit(3), t), t="bad") == "failed after 3 attempts: bad"


def test_captions(spark):
    def say(objects, people=0, place=None, action=None):
        df = spark.createDataFrame([(objects, people, place, action)], "o array<struct<label: string, conf: double, source: string>>, n int, p string, a string")
        return df.select(ft.caption(F.col("o"), ["keys"], ["own"], F.col("n"), F.col("p"), F.col("a")).alias("x")).first().x

    det = "detector"
    assert say([]) == "nothing recognised"
    assert say([("cup", 0.5, det)]) == "cup"
    assert say([("cup", 0.5, det), ("lamp", 0.9, det)], 1) == "lamp and cup, 1 person"
    assert say([("a", 0.9, det), ("b", 0.8, det), ("c", 0.7, det), ("d", 0.6, det)]) == "a, b and c"
    assert say([("a", 0.9, det), ("keys", 0.1, det), ("ring", 0.2, "own"), ("b", 0.8, det)]) == "ring, keys and a"
    assert say([("a", 0.9, det), ("a", 0.8, det)], 2, "inside a car", "driving") == "a, 2 people, inside a car, driving"
    assert say([], 0, "a kitchen") == "in a kitchen"


@pytest.mark.parametrize("n", [1, 9, 10, 11, 18, 19, 25])
def test_word_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, ft.word_chunks(F.col("t"), 10, 2), t=" ".join(words))
    want, i = [], 0
    while True:
        want.append(words[i : i + 10])
        if i + 10 >= n:
            break
        i += 8
    assert [c.chunk.split() for c in got] == want and [c.n_words for c in got] == [len(w) for w in want]


def test_times(spark):
    t = F.col("t")
    show = lambda c: times.stamp_text(c)
    assert one(spark, show(times.parse_iso(t)), t="2025-01-02T03:04:05Z") == "2025-01-02T03:04:05.000Z"
    assert one(spark, show(times.parse_iso(t)), t="2025-01-02T03:04:05+02:00") == "2025-01-02T01:04:05.000Z"
    assert one(spark, times.parse_iso(t), t="soon") is None
    assert one(spark, show(times.container_date(t)), t="20250102T030405.678Z") == "2025-01-02T03:04:05.678Z"
    assert one(spark, show(times.container_date(t)), t="20250102T030405Z") == "2025-01-02T03:04:05.000Z"
    assert one(spark, times.container_date(t), t="19040101T000000.000Z") is None and one(spark, times.container_date(t), t="") is None
    assert one(spark, show(times.moment(times.parse_iso(t), F.lit(1.2345))), t="2025-01-02T03:04:05Z") == "2025-01-02T03:04:06.235Z"
    assert one(spark, times.clock_seconds(t), t="1:02:03.5") == 3723.5 and one(spark, times.clock_seconds(t), t="x:1") is None
    p = one(spark, times.location(t), t="+12.3456-098.7654+010.0/")
    assert (p.lat, p.lon) == (12.3456, -98.7654) and one(spark, times.location(t), t="nowhere") is None


def test_pictures():
    rng = np.random.default_rng(0)
    flat, noise = np.full((40, 60), 100), rng.integers(0, 256, (40, 60))
    assert pictures.brightness(flat) == 100 and pictures.laplacian_variance(flat) == 0
    p = noise.astype(float)
    up, left = np.vstack([p[1], p[:-1]]), np.hstack([p[:, 1:2], p[:, :-1]])
    down, right = np.vstack([p[1:], p[-2]]), np.hstack([p[:, 1:], p[:, -2:-1]])
    assert pictures.laplacian_variance(noise) == pytest.approx((up + down + left + right - 4 * p).var())
    assert pictures.mean_abs_diff(flat, flat + 3) == 3 and pictures.hist_change(flat, flat) == 0 and pictures.hist_change(flat, np.full((40, 60), 200)) == 1
    ramp = np.tile(np.arange(90) * 2, (80, 1))
    assert pictures.dhash(ramp) == 2**64 - 1 and pictures.dhash(ramp[:, ::-1]) == 0 and pictures.dhash(flat) == 0
    rgb = np.zeros((700, 960, 3), np.uint8)
    rgb[...] = 50
    small = pictures.small_gray(rgb)
    assert small.shape == (233, 320) and (small == 50).all()
    assert pictures.to_mono(np.ones((480, 2)), 48_000).tolist() == [1.0] * 160
    assert pictures.to_mono(np.array([1.0, 2.0]), 8_000).tolist() == [1.0, 1.0, 2.0, 2.0] and len(pictures.to_mono(np.zeros(0), 8_000)) == 0


def test_boxes(spark):
    a, b = [0.0, 0.0, 9.0, 9.0], [5.0, 0.0, 14.0, 9.0]
    assert one(spark, boxes.overlap(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(50 / 150)
    rows = [(1, 1, 0.9, a), (1, 2, 0.8, [1.0, 0.0, 10.0, 9.0]), (1, 3, 0.7, [50.0, 50.0, 60.0, 60.0]), (2, 1, 0.5, a)]
    got = boxes.nms(spark.createDataFrame(rows, "frame_id long, id long, conf double, box array<double>"))
    assert {(r.frame_id, r.id) for r in got.collect()} == {(1, 1), (1, 3), (2, 1)}
    crop = lambda box: one(spark, boxes.crop_square(F.col("a"), F.lit(100), F.lit(50)), a=box)
    assert tuple(crop([10.0, 10.0, 40.0, 30.0])) == (10, 5, 30)
    assert tuple(crop([-20.0, -20.0, 30.0, 70.0])) == (0, 0, 50) and crop([0.0, 0.0, 10.0, 40.0]) is None
    schema = "frame_id long, label string, conf double, box array<double>"
    x = spark.createDataFrame([(1, "cup", 0.9, a)], schema)
    y = spark.createDataFrame([(1, "cup", 0.8, [1.0, 0.0, 10.0, 9.0]), (1, "pen", 0.8, a), (1, "cup", 0.8, [70.0, 0.0, 90.0, 9.0])], schema)
    assert sorted((r.label, r.box[0]) for r in boxes.merge_detectors(x, y).collect()) == [("cup", 0.0), ("cup", 70.0), ("pen", 0.0)]
    o = spark.createDataFrame([([("person", 0.9), ("cup", 0.5), ("pen", 0.1), ("person", 0.2)],)], "o array<struct<label: string, conf: double>>")
    r = o.select(boxes.things(F.col("o")).alias("t"), boxes.people(F.col("o")).alias("n")).first()
    assert [x.label for x in r.t] == ["cup"] and r.n == 1
    assert boxes.tiles(100, 60, 40, 3, 2) == [(0, 0), (30, 0), (60, 0), (0, 20), (30, 20), (60, 20)]


def test_decoders():
    logits, box = np.array([[0.0, 2.0], [-3.0, -4.0]]), np.array([[0.5, 0.5, 0.2, 0.4], [0.1, 0.1, 0.1, 0.1]])
    (c, p, b), = boxes.decode_queries(logits, box, 100, 50)
    assert c == 1 and p == pytest.approx(1 / (1 + math.exp(-2))) and b == pytest.approx((40, 15, 60, 35))
    rows = np.zeros((4 * 4 + 2 * 2 + 1, 7))
    rows[5] = [0.5, 0.5, math.log(2), math.log(4), 0.9, 0.1, 0.8]
    (c, p, b), = boxes.decode_grid(rows, 32, 32, 1.0, 0.5)
    assert c == 1 and p == pytest.approx(0.72) and b == pytest.approx((12 - 8, 12 - 16, 12 + 8, 12 + 16))


def test_sound_and_boxed_pictures():
    s = np.array([0.0, 0.5, -0.5, 2.0])
    data = pictures.wav(s)
    assert data[:4] == b"RIFF" and len(data) == 44 + 8 and pictures.read_wav(data) == pytest.approx([0, 0.5, -0.5, 32767 / 32768])
    rgb = np.full((10, 20, 3), 7, np.uint8)
    out, k = pictures.letterbox(rgb, 40, 40)
    assert k == 2.0 and (out[:20] == 7).all() and (out[20:] == 114).all()
    assert pictures.planes(rgb).shape == (3, 10, 20) and pictures.planes(rgb)[0, 0, 0] == pytest.approx(7 / 255)
    rows = np.array([[50.0, 10], [50, 10], [20, 40], [20, 40], [0.1, 0.9], [0.2, 0.1]])
    assert boxes.decode_columns(rows, 2.0, 100, 100, 0.5) == [(0, 0.9, (0.0, 0.0, 15.0, 15.0))]


def test_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    from recollect.functions.tokenizers import token_ids

    df = spark.createDataFrame([("Hello world",), (None,), ("",)], "t string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = [r.i for r in df.select(token_ids(F.col("t"), P.path(name)).alias("i")).collect()]
        assert len(got[0]) >= 2 and got[1] == [] and got[2] == []
    cut = df.select(token_ids(F.col("t"), P.path("word_bpe_49k.json"), 49406, 49407, 3).alias("i")).first().i
    assert len(cut) == 3 and cut[0] == 49406 and cut[-1] == 49407
