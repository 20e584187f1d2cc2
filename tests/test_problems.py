"""Points, orphans and periods against plain versions, with the odd cases each docstring names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import bitmaps, hot, kd, nearby, orphans, outlines, periods


def test_splits_put_each_point_in_one_cell_and_halo_covers_the_radius():
    rng = np.random.default_rng(0)
    pts = kd.unit(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500))
    s = kd.Splits(pts, 16)
    home = s.home(pts)
    assert s.cells == 16 and np.bincount(home).min() > 10
    row, cell = s.reached(pts - 0.1, pts + 0.1)
    reach = set(zip(row.tolist(), cell.tolist()))
    near = np.linalg.norm(pts[:, None] - pts[None], axis=2) <= 0.1
    assert all((j, home[i]) in reach for i, j in zip(*np.nonzero(near)))
    assert all((i, home[i]) in reach for i in range(len(pts)))


@pytest.mark.parametrize("leaf", [1, 7, 48])
def test_close_pairs_equal_brute_force(leaf):
    rng = np.random.default_rng(leaf)
    a, b = rng.normal(size=(200, 3)).round(1), rng.normal(size=(150, 3)).round(1)
    got = {(int(i), int(j)) for x in kd.close_pairs(a, b, 0.4, leaf, 5000) for i, j in zip(*x[:2])}
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 0.16 * (1 + 1e-12)))))
    assert not list(kd.close_pairs(a[:0], b, 1.0))
    w = rng.integers(1, 9, 150)
    for r in (0.4, 3.0, 50.0):
        want = ((d <= r * r * (1 + 1e-12)) * w).sum(1)
        assert kd.close_totals(a, b, w, r, leaf, 5000).tolist() == want.tolist()


def near_brute(rows, metres):
    out = set()
    for i, a, o in rows:
        for j, b, p in rows:
            if i < j:
                d = np.linalg.norm(kd.unit(np.array([a]), np.array([o])) - kd.unit(np.array([b]), np.array([p])))
                if d <= kd.chord(metres):
                    out.add((i, j))
    return out


def test_near_pairs_with_copies_date_line_pole_and_bad_positions(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(10, 10.002, 60), rng.uniform(20, 20.002, 60)))]
    rows += [(f"same{k}", 10.001, 20.001) for k in range(5)]
    rows += [("w", 5.0, 180.0), ("x", 5.0, -180.0), ("y", 5.0001, 179.9999), ("p", 89.9999, 10.0), ("q", 89.9999, -170.0)]
    bad = [("n", None, 1.0), ("nan", float("nan"), 1.0), ("zero", 0.0, 0.0), ("far", 91.0, 0.0), ("w", 5.0, 180.0), (None, 10.0, 20.0)]
    df = spark.createDataFrame(rows + bad, "video string, lat double, lon double").withColumn("id", F.lit("clash"))
    got = nearby.near_pairs(nearby.positions(df, F.col("video"), "lat", "lon"), 40.0, cell_rows=10)
    assert {tuple(r) for r in got.collect()} == near_brute(rows, 40.0)
    none = nearby.positions(df.limit(0), F.col("video"), "lat", "lon")
    assert nearby.near_pairs(none, 40.0).count() == 0


@pytest.mark.parametrize("cells, group", [(10, 32_768), (500, 25)])
def test_a_crowd_is_dealt_into_pairs_of_groups(spark, cells, group):
    rng = np.random.default_rng(8)
    rows = [(f"v{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(10, 10.0004, 120), rng.uniform(20, 20.0004, 120)))]
    rows += [(f"w{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(-80, 80, 120), rng.uniform(-180, 180, 120)))] + [("v0b", *rows[0][1:])]
    points = spark.createDataFrame(rows, "id string, lat double, lon double")
    want = near_brute(rows, 30.0)
    assert len(want) > 2000
    assert {tuple(r) for r in nearby.near_pairs(points, 30.0, cell_rows=cells, group_rows=group).collect()} == want
    got = {(r.lat, r.lon): (r.n_here, r.n_near) for r in nearby.near_counts(nearby.Spots(points), 30.0, cell_rows=cells, group_rows=group).collect()}
    near = {}
    for i, j in want:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    at = {}
    for i, a, o in rows:
        at.setdefault((a, o), set()).add(i)
    assert got == {(a, o): (len(at[a, o]), len(near.get(i, set()) - at[a, o])) for i, a, o in rows}


def test_cells_are_never_narrower_than_two_radii():
    rng = np.random.default_rng(2)
    pts = np.concatenate([kd.unit(rng.uniform(10, 10.0002, 5000), rng.uniform(20, 20.0002, 5000)), kd.unit(rng.uniform(-90, 90, 5000), rng.uniform(-180, 180, 5000))])
    r = kd.chord(40.0)
    s = kd.Splits(pts, 2048, 2 * r)
    row, cell = s.reached(pts - r, pts + r)
    assert np.bincount(row).max() <= 8 and s.cells > 500
    assert np.array_equal(np.sort(s.home(pts[:100])), np.sort(s.reached(pts[:100], pts[:100])[1]))


def test_clipped_edges_keep_the_parity_of_every_cell():
    rng = np.random.default_rng(4)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 3000))
    size = rng.uniform(3, 9, 3000)
    edges, _ = outlines.ring_edges(size * np.sin(angle), size * np.cos(angle))
    lat, lon = rng.uniform(-12, 12, 4000), rng.uniform(-12, 12, 4000)
    whole = set(outlines.inside(lat, lon, edges, np.zeros(len(edges), int), np.array([False]))[0].tolist())
    splits = kd.Splits(np.stack([lon, lat], axis=1), 40)
    home, found, sent = splits.home(np.stack([lon, lat], axis=1)), set(), 0
    for c in range(splits.cells):
        e = outlines.clipped(edges, splits.lo_a[c], splits.hi_a[c])
        sent += len(e)
        at = np.flatnonzero(home == c)
        if len(e):
            found |= set(at[outlines.inside(lat[at], lon[at], e, np.zeros(len(e), int), np.array([False]))[0]].tolist())
    assert found == whole and sent < 6 * len(edges)


def ray_inside(lat, lon, ring):
    hit = False
    n = len(ring)
    for k in range(n):
        (a0, o0), (a1, o1) = ring[k], ring[(k + 1) % n]
        o0, o1 = (o0 - lon + 180) % 360 - 180, (o1 - lon + 180) % 360 - 180
        if o1 - o0 > 180:
            o1 -= 360
        elif o1 - o0 < -180:
            o0 -= 360
        for s in (-360, 0, 360):
            u, v = o0 + s, o1 + s
            if (u <= 0) != (v <= 0) and a0 + (0 - u) * (a1 - a0) / (v - u) > lat:
                hit = not hit
    return hit


def test_containing_equals_ray_casting(spark):
    rng = np.random.default_rng(5)
    rings = {
        "box": [(0, 0), (0, 10), (10, 10), (10, 0)],
        "closed": [(2, 2), (2, 5), (5, 5), (2, 2)],
        "line": [(-5.0, 175.0), (-5.0, -175.0), (5.0, -175.0), (5.0, 175.0)],
        "star": [(0, 170), (8, 175), (0, -170), (4, 171), (1, -175)],
        "two": [(0, 0), (1, 1)],
    }
    pts = [(f"p{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(-8, 12, 400), np.where(rng.random(400) < 0.5, rng.uniform(-2, 12, 400), rng.uniform(168, 192, 400))))]
    pts = [(k, a, o if o <= 180 else o - 360) for k, a, o in pts]
    places = spark.createDataFrame(
        [(k, [(float(a), float(o)) for a, o in v]) for k, v in rings.items()] + [("none", None), ("hole", [(0.0, 0.0), None, (1.0, 1.0), (1.0, 0.0)]), ("nolat", [(None, 0.0), (1.0, 1.0), (1.0, 0.0)])],
        "id string, outline array<struct<lat double, lon double>>",
    )
    points = spark.createDataFrame(pts, "id string, lat double, lon double")
    want = {(i, k) for i, a, o in pts for k, v in rings.items() if len(v) > 2 and ray_inside(a, o, v)}
    assert len(want) > 50
    assert {tuple(r) for r in nearby.containing(points, places, cell_rows=30).collect()} == want
    assert nearby.containing(points.limit(0), places).count() == 0
    assert nearby.containing(points, places.limit(0)).count() == 0


def test_ring_round_a_pole():
    lon = np.array([-180.0, -90.0, 0.0, 90.0])
    for lat, pole in ((80.0, 1), (-80.0, -1)):
        edges, held = outlines.ring_edges(np.full(4, lat), lon)
        assert held == pole
        p, _ = outlines.inside(np.array([89.0, 0.0, -89.0]), np.array([3.0, 3.0, 3.0]), edges, np.zeros(len(edges), int), np.array([held > 0]))
        assert p.tolist() == ([0] if pole > 0 else [2])


def test_points_below_a_corner_at_the_date_line():
    rng = np.random.default_rng(7)
    lon = np.round(np.r_[rng.uniform(179.99, 180, 12), rng.uniform(-180, -179.99, 12)], 7)
    lat = np.round(rng.uniform(10, 10.01, 24), 7)
    order = np.argsort(np.arctan2(lat - 10.005, (lon % 360) - 180))
    lon, lat = lon[order], lat[order]
    edges, held = outlines.ring_edges(lat, lon)
    assert held == 0
    for far in (-50.0, 9.0, 11.0, 80.0):  # under and over every corner, outside of the ring
        p, _ = outlines.inside(np.full(24, far), lon, edges, np.zeros(len(edges), int), np.array([False]))
        assert len(p) == 0


def test_bitmaps_equal_sets():
    rng = np.random.default_rng(1)
    for n in (0, 10, 5000, 60000):
        for m in (0, 10, 5000, 60000):
            a, b = rng.integers(0, 200_000, n), rng.integers(0, 200_000, m)
            x = bitmaps.Bitmap(a).and_not(bitmaps.Bitmap(b))
            want = sorted(set(a.tolist()) - set(b.tolist()))
            assert x.values().tolist() == want and len(x) == len(want)


def test_orphans(spark):
    refs = spark.createDataFrame(
        [("t", 1, "2025-01", "a"), ("t", 2, "2025-01", "b"), ("t", 3, "2025-01", "b"), ("t", 3, "2025-02", "b"), ("u", 1, None, "c"), ("u", 4, "2025-01", None)],
        "src string, row_id long, ym string, key string",
    )
    parents = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    lost = orphans.orphan_keys(refs, parents, 4, keys_per_range=1)
    assert {tuple(r) for r in lost.collect()} == {("t", "2025-01", "b", 2), ("t", "2025-02", "b", 1), ("u", None, "c", 1)}
    assert {tuple(r) for r in orphans.orphan_rows(refs, lost, 6).collect()} == {("t", 2, "2025-01"), ("t", 3, "2025-01"), ("t", 3, "2025-02"), ("u", 1, None)}
    assert orphans.orphan_keys(refs.limit(0), parents, 0).count() == 0
    assert orphans.orphan_keys(refs, parents.limit(0), 4).count() == 4


def test_references_keep_every_key_that_deliveries_name(spark):
    rows = [(1, "b", 3), (1, "a", 1), (1, "c", 2), (1, None, 0), (2, None, 1), (3, "b", 5), (None, "x", 1)]
    df = spark.createDataFrame(rows, "id long, k string, day int").withColumn("loaded_at", F.timestamp_seconds(F.lit(1735689600) + F.col("day") * 86400 * 30)).withColumn("key", F.lit("clash"))
    got = {tuple(r) for r in orphans.references(df, "t", "id", F.col("k")).collect()}
    assert got == {("t", 1, "2025-01", k) for k in "abc"} | {("t", 3, "2025-05", "b"), ("t", None, "2025-01", "x")}


def test_orphans_by_number_and_ranges_of_lost_parents(spark):
    ids = spark.range(0, 300_000, 3).select(F.col("id").alias("key"))
    refs = spark.range(299_000, 300_100).select(F.lit("x").alias("src"), F.col("id").alias("row_id"), F.lit("m").alias("ym"), F.col("id").alias("key"))
    got = {r.key for r in orphans.orphan_keys(refs, ids, 101_100, keys_per_range=50_000).collect()}
    assert got == {k for k in range(299_000, 300_100) if k % 3 or k >= 300_000}
    far = refs.withColumn("key", F.col("key") * 65536)
    lost = orphans.orphan_keys(far, ids.limit(0), 1100, keys_per_range=100)
    assert lost.count() == 1100


def test_a_hot_key_is_dealt(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    keys = hot.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], 1000, hot_rows=100)
    assert [tuple(r) for r in keys.collect()] == [("hot", 7)]
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("800", 3), ("none", 4)], "k string, x int")
    got = hot.salted_join(big, other, ["k"], keys, ["id"])
    assert got.count() == 1401 and set(got.columns) == {"k", "id", "x"}
    assert hot.salted_join(big, other, ["k"], keys, ["id"], "left_anti").count() == 299
    assert hot.salted_join(big, other, ["k"], keys, ["id"], "left_semi").distinct().count() == 701


def test_existing_after_last_removal(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1), ("c", None), ("d", 3)], "key string, at int")
    gone = spark.createDataFrame([("a", 3), ("b", 2), ("b", 0), ("d", 3), ("z", 1), ("a", None)], "key string, gone_at int")
    assert {r.key for r in orphans.existing(rows, "key", "at", gone, "gone_at").collect()} == {"a", "c"}


def plain_periods(rows):
    out = {}
    for k, s, e in rows:
        if k is None or s is None or e is None or s != s or e != e:
            continue
        s, e = (round(max(-9e15, min(9e15, x * 1000))) for x in (s, e))
        if e > s:
            out.setdefault(k, []).append((s, e))
    found = {}
    for k, v in out.items():
        v.sort()
        p = [list(v[0])]
        for s, e in v[1:]:
            if s > p[-1][1]:
                p.append([s, e])
            else:
                p[-1][1] = max(p[-1][1], e)
        found[k] = [tuple(x) for x in p]
    return found


@pytest.mark.parametrize("slice_ms", [500, 7_000, 600_000])
def test_periods_and_gaps(spark, slice_ms):
    rng = np.random.default_rng(slice_ms)
    s = rng.integers(-2000, 100_000, 300) / 1000
    rows = [(str(k % 4), float(a), float(a + w)) for k, (a, w) in enumerate(zip(s, rng.exponential(0.4, 300).round(3)))]
    rows += [("long", 0.0, 90.0), ("long", 1.0, 2.0), ("long", 95.0, 96.0), ("long", 90.0, 90.5), ("hot", 1.0, 2.0)]
    rows += [("hot", 1.0, 2.0)] * 50 + [("inf", 0.0, float("inf")), ("inf", 5.0, 6.0), ("inf", float("-inf"), -1.0)]
    rows += [(None, 1.0, 2.0), ("n", None, 1.0), ("n", 1.0, None), ("n", float("nan"), 2.0), ("n", 3.0, 2.0), ("n", 3.0, 3.0), ("n", 1.0, 1.0001)]
    df = spark.createDataFrame(rows, "k0 string, a double, b double").withColumn("s", F.lit("clash")).withColumn("slice", F.lit(1))
    want = plain_periods(rows)
    got = {}
    for r in periods.periods(df, [F.col("k0")], "a", "b", slice_ms).collect():
        got.setdefault(r.k0, []).append((r.period_no, r.start_ms, r.end_ms, r.gap_before_ms))
    for k, v in got.items():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
        assert [x[1:3] for x in v] == want[k]
        assert [x[3] for x in v] == [None] + [b[0] - a[1] for a, b in zip(want[k], want[k][1:])]
    assert set(got) == set(want)
    g = {tuple(r) for r in periods.gaps(df, [F.col("k0")], "a", "b", slice_ms).collect()}
    assert g == {(k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:])}
    assert periods.periods(df.limit(0), [F.col("k0")], "a", "b").count() == 0
