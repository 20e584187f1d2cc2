"""Points near other points, and points inside outlines, of tables far larger than one machine.

Near pairs: equal positions are one class with a count. Positions become unit vectors; k-d splits of a bounded sample cut
space into cells no narrower than two radii, so a position reaches at most eight; it goes to its own cell and, as a halo
copy, to every other cell within the radius. A cell that the sample shows to hold more than `group_rows` is dealt into
groups, and every pair of groups is a block of its own: a task holds two groups at most, however dense the crowd. In a
block two local k-d trees are walked together by chord. A pair is told by the cell that owns its smaller position.
The ordinary result are classes with counts; near_pairs() expands them to ids, by joins that deal shared places.

Outlines: the same splits over (lon, lat); an outline's edges go to the cells that its box touches, clipped to those that
can lie north of the cell's points; in the cell a sweep along the longitude counts the edges north of each position.

Defined cases: a null, NaN or out-of-range coordinate, or both zero, is no position; repeated rows count once; an id
with two positions is near whatever either is near; an outline of fewer than three corners, or with a corner that is
missing or not finite, holds nothing; a ring round a pole holds the pole on its side of the equator; points exactly on
an edge may fall on either side. Empty inputs give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.hot import hot_keys, salted_join
from recollect.operators.kd import Splits, chord, close_pairs, close_totals, unit
from recollect.operators.outlines import clipped, inside, ring_edges
from recollect.session import checkpointed, spread

SAMPLE = 100_000  # positions of the sample that places the cuts; they only steer balance, never the result
CELL_ROWS = 8_000
MAX_CELLS = 16_384
GROUP_ROWS = 32_768  # positions of one cell that go to a task together
PLACE = ["lat", "lon"]


def positions(df: DataFrame, key, lat: str, lon: str) -> DataFrame:
    """Distinct id, lat, lon of the rows with a position."""
    a, o = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = a.between(-90.0, 90.0) & o.between(-180.0, 180.0) & ~((a == 0.0) & (o == 0.0)) & ~F.isnan(a) & ~F.isnan(o)
    return df.where(ok).select(key.alias("id"), a.alias("lat"), o.alias("lon")).where(F.col("id").isNotNull()).distinct()


class Spots:
    """The distinct positions of points (id, lat, lon) as a checkpoint `table` (lat, lon, n: ids at it), their number, that
    of the points, and about SAMPLE positions, picked by their hash: the same ones whatever the partitions."""

    def __init__(self, points: DataFrame):
        self.table = checkpointed(points.groupBy(*PLACE).agg(F.count("*").alias("n")))
        r = self.table.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("points")).first()
        self.rows, self.points = r["rows"], r["points"]
        share = round(min(1.0, SAMPLE / max(1, self.rows)) * (1 << 30))
        held = self.table.where(F.pmod(F.xxhash64(*PLACE), F.lit(1 << 30)) < share).select(*PLACE).toPandas()
        self.lat, self.lon = held["lat"].to_numpy(float), held["lon"].to_numpy(float)
        self.scale = max(1.0, self.rows / max(1, len(held)))

    def hot(self) -> DataFrame:
        return hot_keys(self.table, PLACE, self.points)


class _Blocks:
    """Cells dealt into groups, and the number of each pair of groups."""

    def __init__(self, expect: np.ndarray, group_rows: int):
        self.groups = np.maximum(1, np.ceil(expect / group_rows)).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.groups * self.groups)])
        self.n = int((self.groups * (self.groups + 1) // 2).sum())

    def of(self, cell: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, group) for every block that a row of a cell joins; mark: a hash of the row."""
        g = self.groups[cell]
        mine = mark % g
        row = np.repeat(np.arange(len(cell)), g)
        other = np.arange(len(row)) - np.repeat(np.cumsum(g) - g, g)
        lo, hi = np.minimum(mine[row], other), np.maximum(mine[row], other)
        return row, self.base[cell[row]] + lo * g[row] + hi, mine[row]


def _mark(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    bits = (lat + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (lon + 0.0).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((bits ^ (bits >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(2)).astype(np.int64)


def _near(spots: Spots, metres: float, found, schema: str, cell_rows: int, max_cells: int, group_rows: int) -> DataFrame:
    """found(pdf, pts, sides, r) for every block: the positions of one group, or of two, and which of them the cell owns."""
    r = chord(metres)
    sample = unit(spots.lat, spots.lon)
    splits = Splits(sample, min(max_cells, -(-spots.rows // cell_rows)), 2 * r)
    reach = r * (1 + 1e-9)
    blocks = _Blocks(np.bincount(splits.reached(sample - reach, sample + reach)[1], minlength=splits.cells) * spots.scale, group_rows)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            lat, lon, n = (pdf[c].to_numpy() for c in ("lat", "lon", "n"))
            pts = unit(lat, lon)
            own = splits.home(pts)
            row, cell = splits.reached(pts - reach, pts + reach)
            at, part, group = blocks.of(cell, _mark(lat, lon)[row])
            mine, at = (own[row] == cell)[at], row[at]
            yield pd.DataFrame({"part": part, "grp": group, "own": mine, "lat": lat[at], "lon": lon[at], "n": n[at]})

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))  # two groups
        group = pdf["grp"].to_numpy()
        sides = [np.flatnonzero(group == g) for g in np.unique(group)]
        if len(sides) == 2 or pdf["part"].iloc[0] in ends:  # else the block of two groups, one of them empty
            yield from found(pdf, unit(pdf["lat"].to_numpy(), pdf["lon"].to_numpy()), sides, r)

    g = np.repeat(blocks.groups, blocks.groups)
    k = np.arange(len(g)) - np.repeat(np.cumsum(blocks.groups) - blocks.groups, blocks.groups)
    ends = set((np.repeat(blocks.base[:-1], blocks.groups) + k * g + k).tolist())  # blocks of one group with itself
    placed = spots.table.mapInPandas(place, "part long, grp long, own boolean, lat double, lon double, n long")
    return spread(placed, "part", blocks.n, spots.rows * 48).groupBy("part").applyInPandas(join, schema)


def near_classes(spots: Spots, metres: float, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """lat_a, lon_a, lat_b, lon_b: pairs of different positions at most `metres` apart, each once."""

    def found(pdf: pd.DataFrame, pts: np.ndarray, sides: list[np.ndarray], r: float) -> Iterator[pd.DataFrame]:
        lat, lon, own = (pdf[c].to_numpy() for c in ("lat", "lon", "own"))
        p, q = sides[0], sides[-1]
        for i, j, _ in close_pairs(pts[p], pts[q], r):  # piece by piece: a block may have more pairs than memory
            i, j = p[i], q[j]
            first = (lat[i] < lat[j]) | ((lat[i] == lat[j]) & (lon[i] < lon[j]))
            if len(sides) == 1:
                i, j = i[first], j[first]
            else:
                i, j = np.where(first, i, j), np.where(first, j, i)
            told = own[i]  # the smaller position's own cell tells the pair
            i, j = i[told], j[told]
            yield pd.DataFrame({"lat_a": lat[i], "lon_a": lon[i], "lat_b": lat[j], "lon_b": lon[j]})

    return _near(spots, metres, found, "lat_a double, lon_a double, lat_b double, lon_b double", cell_rows, max_cells, group_rows)


def near_counts(spots: Spots, metres: float, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """lat, lon, n_here, n_near: for every position the ids at it, and those at other positions at most `metres` away.

    No pair leaves its task, so a crowd costs its comparisons and nothing else."""

    def found(pdf: pd.DataFrame, pts: np.ndarray, sides: list[np.ndarray], r: float) -> Iterator[pd.DataFrame]:
        n, own = pdf["n"].to_numpy(), pdf["own"].to_numpy()
        for p, q in [(sides[0], sides[0])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]:
            mine = p[own[p]]
            total = close_totals(pts[mine], pts[q], n[q], r)
            if len(sides) == 1:
                total -= n[mine]  # itself
            at = mine[total > 0]
            yield pd.DataFrame({"lat": pdf["lat"].to_numpy()[at], "lon": pdf["lon"].to_numpy()[at], "n": total[total > 0]})

    parts = _near(spots, metres, found, "lat double, lon double, n long", cell_rows, max_cells, group_rows)
    near = parts.groupBy(*PLACE).agg(F.sum("n").alias("n_near"))
    return spots.table.withColumnRenamed("n", "n_here").join(near, PLACE, "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def near_pairs(points: DataFrame, metres: float, spots: Spots | None = None, **how) -> DataFrame:
    """id_a < id_b: different ids of points (id, lat, lon) with positions at most `metres` apart.

    points is read several times, so it should be a checkpoint or a table. spots: Spots(points), if at hand."""
    spots = spots or Spots(points)
    pairs, hot = near_classes(spots, metres, **how), spots.hot()
    ids = points.select("id", *PLACE)
    a = salted_join(ids, pairs.withColumnsRenamed({"lat_a": "lat", "lon_a": "lon"}), PLACE, hot, ["id"])
    a = a.select(F.col("id").alias("id_a"), F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"))
    apart = salted_join(ids.withColumnRenamed("id", "id_b"), a, PLACE, hot, ["id_b"]).where("id_a <> id_b")
    told = apart.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    shared = ids.join(spots.table.where("n > 1").select(*PLACE), PLACE, "left_semi")
    same = salted_join(shared.withColumnRenamed("id", "id_b"), shared.withColumnRenamed("id", "id_a"), PLACE, hot, ["id_b"]).where("id_a < id_b")
    return told.unionByName(same.select("id_a", "id_b")).distinct()


def containing(points: DataFrame, places: DataFrame, spots: Spots | None = None, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id_a (of points: id, lat, lon), id_b (of places: id, outline array<struct<lat, lon>>): the point lies inside.

    points and spots as in near_pairs."""
    spots = spots or Spots(points)

    def flat(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.stack([(lon + 180.0) % 360.0 - 180.0, lat], axis=1)

    sample = flat(spots.lat, spots.lon)
    splits = Splits(sample, min(max_cells, -(-spots.rows // cell_rows)))
    # a cell's positions are dealt to several tasks where they are many; each of them sees all of the cell's edges
    expect = np.bincount(splits.home(sample), minlength=splits.cells) * spots.scale
    deals = np.maximum(1, np.ceil(expect / group_rows)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(deals)])

    def place_spots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            cell = splits.home(flat(lat, lon))
            yield pd.DataFrame({"lat": lat, "lon": lon, "part": base[cell] + _mark(lat, lon) % deals[cell]})

    def place_rings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, la, lo in zip(pdf["id"], pdf["la"], pdf["lo"]):
                made = ring_edges(np.asarray(la, float), np.asarray(lo, float)) if la is not None and lo is not None else None
                if made is None or not len(made[0]):
                    continue
                edges, pole = made
                low = -90.0 if pole < 0 else edges[:, [1, 3]].min()
                high = 90.0 if pole > 0 else edges[:, [1, 3]].max()
                # by halves of the globe, so that a ring over the date line doesn't reach every cell
                touched: set[int] = set()
                for west, east in ((-180.0, 0.0), (0.0, 180.0)):
                    half = edges[(edges[:, 0] < east) & (edges[:, 2] >= west)]
                    if len(half):
                        lo_b = np.array([[max(west, half[:, 0].min()), low]])
                        hi_b = np.array([[min(east, half[:, 2].max()), high]])
                        touched |= set(splits.reached(lo_b, hi_b)[1].tolist())
                parts_of, sent = [], []
                for c in sorted(touched):
                    part = clipped(edges, splits.lo_a[c], splits.hi_a[c])
                    if len(part) or pole > 0:
                        parts_of += range(base[c], base[c + 1])
                        sent += [part.ravel()] * int(deals[c])
                if sent:
                    yield pd.DataFrame({"id": key, "part": np.array(parts_of, np.int64), "edges": sent, "pole": pole > 0})

    def sweep(_, pts: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        if pts.empty or rings.empty:
            return pd.DataFrame({"lat": np.zeros(0), "lon": np.zeros(0), "id_b": np.zeros(0, object)})
        each = [np.asarray(e, float).reshape(-1, 4) for e in rings["edges"]]
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        lat, lon = pts["lat"].to_numpy(), pts["lon"].to_numpy()
        p, o = inside(lat, lon, np.concatenate(each), owner, rings["pole"].to_numpy())
        return pd.DataFrame({"lat": lat[p], "lon": lon[p], "id_b": rings["id"].to_numpy()[o]})

    a = spots.table.select(*PLACE).mapInPandas(place_spots, "lat double, lon double, part long")
    corners = places.where(F.col("id").isNotNull() & F.col("outline").isNotNull() & ~F.exists("outline", lambda c: c.isNull()))
    corners = corners.select("id", F.col("outline.lat").alias("la"), F.col("outline.lon").alias("lo"))
    corners = corners.where(~F.exists("la", lambda x: x.isNull()) & ~F.exists("lo", lambda x: x.isNull()))
    b = corners.mapInPandas(place_rings, "id string, part long, edges array<double>, pole boolean")
    held = a.groupBy("part").cogroup(b.groupBy("part")).applyInPandas(sweep, "lat double, lon double, id_b string")
    found = salted_join(points.select(F.col("id").alias("id_a"), *PLACE), held, PLACE, spots.hot(), ["id_a"])
    return found.select("id_a", "id_b").distinct()


__all__ = ["Spots", "containing", "near_classes", "near_counts", "near_pairs", "positions"]
