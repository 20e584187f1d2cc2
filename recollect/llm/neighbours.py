"""The k most similar vectors of every vector, by a block matrix join.

Rows with one and the same direction, to 24 bits a component, form a class, named by its smallest id. Centroids of a bounded sample cut the unit
sphere into cells of about `cell_rows` classes (coarse ones on the driver, the cells' by tasks within those). Each class joins the block of its nearest cell, and those of up to
`probes` - 1 others whose centroids are almost as near (by `gap` of cosine): classes amid their cell need no others. It
travels as int8 codes and the 16 bits that complete each component to 24, so four copies cost as much as three floats.
In a block, products of int8 tiles tell every cosine up to a proven quantisation error; only pairs that could still be
among a row's k best (and reach `at_least`) are recomputed in full precision. The blocks' short lists are merged by class.
A cell that the sample shows to hold more than BLOCK classes is dealt into groups, and every pair of groups is a block
of its own, so a third of all rows near one point neither gathers in one task nor loses a pair. All pairs that share a cell
are compared, whatever the size of the table or the cell: more rows than MAX_CELLS cells of the wanted size make larger
cells, which lose less and cost more. How a cell is dealt decides about tasks and copies only, not about results.

The only loss is of neighbours that share none of these cells (the README has the recall measured).

Defined cases: null, unreadable, wrong-sized, infinite, NaN and all-zero vectors are left out; repeated rows count
once; copies of a vector are each other's neighbours at cosine 1, smaller id first; equal cosines (to 6 decimals) go
by the smaller id; empty and one-row tables give empty results. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.hot import hot_keys, salted_join
from recollect.session import checkpointed, spread

CELL_ROWS = 512
PROBES = 6
GAP = 0.10
SAMPLE = 4_096  # rows that the driver sees, for coarse centroids; every row is indexed
FIT = 48  # sampled rows a cell that the centroids are fitted on, by tasks
MAX_CELLS = 8_192
BLOCK = 4_096  # classes in a block
TIGHT = 0.9  # centroids at least so alike are one cell
MERGED = 65_536
LARGE_BLOCK = 65_536  # the most classes in a block of two groups
COPIES = 16  # groups of a cell, and so copies of a class, before its groups grow beyond BLOCK
TILE = 512 * 8_192
MICRO = 1_000_000


def usable(df: DataFrame, key: str, vector, dim: int) -> DataFrame:
    """id, v of the rows whose vector can be compared. vector: a column of array<float> or array<double>."""
    rows = df.select(F.col(key).cast("long").alias("id"), vector.cast("array<double>").alias("v"))
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # very small and very large ones too
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of each row against its largest component, and the 16 bits that complete them."""
    fine = np.rint(unit * (127.0 * 65536.0 / np.abs(unit).max(1))[:, None]).astype(np.int64)
    code = (fine + 32768) >> 16
    return code.astype(np.int8), (fine - (code << 16) + 32768).astype(np.uint16)


def decode(code: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the scale by which a code stands for a component."""
    fine = ((code.astype(np.int64) << 16) + rest.astype(np.int64) - 32768).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", fine, fine))
    return fine / length[:, None], 65536.0 / length


def bits_of(unit: np.ndarray) -> np.ndarray:
    """(n, 3 dim) bytes: what a vector travels as; equal bytes are one class."""
    code, rest = encode(unit)
    return np.ascontiguousarray(np.concatenate([code.view(np.uint8), rest.view(np.uint8).reshape(len(rest), -1)], axis=1))


def _keys(bits: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_128_digest(r) for r in bits], dtype="V16")


def centroids(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means over the distinct vectors of the sample."""
    x = np.unique(sample.astype(np.float32), axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(cells, len(x))]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        total = np.add.reduceat(x[order], heads, axis=0)
        size = np.linalg.norm(total, axis=1)
        ok = size > 0
        c[near[order][heads[ok]]] = total[ok] / size[ok, None]
    return c


def tight(c: np.ndarray, size: np.ndarray, most: float = MERGED) -> np.ndarray:
    """For each centroid the one that it is merged with: a crowd round one point is one cell, not many that each row would
    have to choose among. The largest first, a centroid takes those within TIGHT of it. No cell grows beyond `most` classes."""
    root = np.arange(len(c))
    some = np.concatenate([((c[a : a + 1024] @ c.T) >= TIGHT).sum(1) > 1 for a in range(0, len(c), 1024)])
    near = np.flatnonzero(some)  # only those with another one so near can be merged
    near = near[np.argsort(-size[near], kind="stable")]
    v, free = c[near], np.ones(len(near), bool)
    for k in range(len(near)):
        if free[k]:
            free[k] = False
            at = np.flatnonzero(free & (v @ v[k] >= TIGHT))
            at = at[size[near[k]] + np.cumsum(size[near[at]]) <= most]
            root[near[at]] = near[k]
            free[at] = False
    return root


def nearest_cells(unit: np.ndarray, c: np.ndarray, probes: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs: the nearest centroid of each row, and up to probes - 1 more that are nearer than it less gap."""
    rows, cells = [], []
    probes = min(probes, len(c))
    for a in range(0, len(unit), 2048):
        s = unit[a : a + 2048].astype(np.float32) @ c.T
        few = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        v = np.take_along_axis(s, few, axis=1)
        i, j = np.nonzero(v >= v.max(1, keepdims=True) - gap)
        rows.append(i + a)
        cells.append(few[i, j])
    return np.concatenate(rows), np.concatenate(cells)


def tile_codes(unit: np.ndarray) -> dict[str, np.ndarray]:
    """int8 codes of the rows' differences from their mean: the closer a block lies, the finer they are.

    u . v = base(u) + base(v) + du . dv; err is the length of what the codes leave of du, size the length of du."""
    mean = unit.mean(0)
    d = unit - mean
    top = np.abs(d).max(1)
    scale = np.where(top > 0, top, 1.0) / 127.0
    code = np.rint(d / scale[:, None])
    length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    return {"code": code.astype(np.int8), "scale": scale, "err": length(d - code * scale[:, None]), "size": length(d), "base": unit @ mean - mean @ mean / 2}


def tile_candidates(x: dict, y: dict, k: int, at_least: float | None, same: bool, cosines: int = TILE):
    """Yields (i, j): the pairs that may be among the k best of row i of x, judged by int8 products and error bounds.

    same: x and y are one and the same block. cosines: how many are held at once, about."""
    rows = max(16, min(512, cosines // max(1, len(y["code"]))))
    b = y["code"].astype(np.float32).T
    by_scale, by_base = y["scale"].astype(np.float32), y["base"].astype(np.float32)
    worst, longest = float(y["err"].max()), float(y["size"].max())
    for a in range(0, len(x["code"]), rows):
        at = slice(a, a + rows)
        # products of int8 codes are whole numbers below 2^24: exact in float32
        s = x["code"][at].astype(np.float32) @ b
        s *= by_scale
        s *= x["scale"][at, None].astype(np.float32)
        s += by_base
        s += x["base"][at, None].astype(np.float32)
        slack = x["err"][at] * longest + (x["size"][at] + x["err"][at]) * worst + 2e-6
        if same:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -4.0
        if at_least is not None:
            least = at_least - slack
            many = np.count_nonzero(s >= least[:, None], axis=1) > 8 * k
            if many.any():  # rows amid a crowd: their k-th best bounds the rest
                t = s[many]
                least[many] = np.maximum(least[many], np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k] - 2 * slack[many])
            i, j = np.nonzero(s >= least[:, None])
            v = s[i, j]
            order = np.lexsort((-v, i))
            i, j, v = i[order], j[order], v[order]
            head = np.searchsorted(i, np.arange(len(s)))
            size = np.diff(np.r_[head, len(i)])
            kth = np.where(size >= k, v[np.minimum(head + k - 1, max(0, len(v) - 1))] if len(v) else 0.0, -9.0)
            keep = v >= kth[i] - 2 * slack[i]
            i, j = i[keep], j[keep]
        else:
            place = s.shape[1] - min(k, s.shape[1])
            kth = np.partition(s, place, axis=1)[:, place]
            i, j = np.nonzero((s >= (kth - 2 * slack)[:, None]) & (s > -3.0))
        yield i + a, j


def block_best(ids: np.ndarray, code, rest, group: np.ndarray, k: int, at_least: float | None):
    """(a, b, micro): for each class of the block its k best others, of the other group if there are two."""
    unit, _ = decode(code, rest)
    tiles = tile_codes(unit)
    parts = np.unique(group)
    sides = [np.flatnonzero(group == g) for g in parts]
    turns = [(sides[0], sides[0], True)] if len(sides) == 1 else [(sides[0], sides[1], False), (sides[1], sides[0], False)]
    found = []
    for p, q, same in turns:
        if len(p) == 0 or len(q) == 0 or (same and len(p) < 2):
            continue
        x, y = ({c: v[rows] for c, v in tiles.items()} for rows in (p, q))
        for i, j in tile_candidates(x, y, k, at_least, same):
            i, j = p[i], q[j]
            cos = np.concatenate([np.einsum("ij,ij->i", unit[i[x : x + 65536]], unit[j[x : x + 65536]]) for x in range(0, len(i), 65536)] or [np.zeros(0)])
            micro = np.rint(np.minimum(cos, 1.0) * MICRO).astype(np.int64)
            if at_least is not None:
                ok = micro >= round(at_least * MICRO)
                i, j, micro = i[ok], j[ok], micro[ok]
            order = np.lexsort((ids[j], -micro, i))
            i, j, micro = i[order], j[order], micro[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < k
            found.append((ids[i[best]], ids[j[best]], micro[best]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def cut_block_best(ids: np.ndarray, code, rest, group: np.ndarray, k: int, at_least: float | None, cell_rows: int, probes: int):
    """block_best of a large block through its own cells: the same rule again, so the work stays in proportion, but pairs are
    lost that block_best finds. For callers that choose it; no query does, at any size.

    Cells of a crowd are one here too, with no bound but the block: none of the pairs that came together here is lost."""
    if len(ids) <= 4 * cell_rows:
        return block_best(ids, code, rest, group, k, at_least)
    unit, _ = decode(code, rest)
    step = max(1, len(ids) // SAMPLE)
    c = centroids(unit[::step], max(1, round(len(ids) / cell_rows)))
    root = tight(c, np.zeros(len(c)), np.inf)
    row, cell = nearest_cells(unit, c, probes)
    del unit
    both = np.unique(root[cell] * len(ids) + row)  # by cell
    cell, row = both // len(ids), both % len(ids)
    heads = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
    found = [block_best(ids[r], code[r], rest[r], group[r], k, at_least) for r in (row[a:b] for a, b in zip(heads, heads[1:])) if len(np.unique(group[r])) == len(np.unique(group))]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    a, b, micro = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, -micro, a))
    a, b, micro = a[order], b[order], micro[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]  # a pair of two cells has one cosine
    a, b, micro = a[new], b[new], micro[new]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[best], b[best], micro[best]


def _picked(vectors: DataFrame, share: float) -> DataFrame:
    """About that share of the rows, by the hash of their ids: the same ones whatever the partitions."""
    return vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < round(min(1.0, share) * (1 << 30)))


def fitted(vectors: DataFrame, dim: int, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of the cells, the distinct rows of the fitting sample near each, scaled to all rows, and a small sample.

    The driver makes coarse centroids from about SAMPLE rows; tasks fit the cells' centroids within these, on about FIT
    rows a cell. So what the driver gets is the small sample and the centroids."""
    held = _picked(vectors.select("id", F.col("v").cast("array<float>").alias("v")), SAMPLE / max(1, rows)).select("v").toArrow()
    sample = np.concatenate([_unit(_matrix(x, dim)) for x in held["v"].chunks if len(x)] or [np.ones((1, dim))])
    coarse = centroids(sample, max(1, round(cells**0.5)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(0), dim)
            if len(v):
                u = _unit(v).astype(np.float32)
                blob = pa.array([r.tobytes() for r in u], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nearest_cells(u, coarse, 1)[1]), blob], names=["grp", "u"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.frombuffer(b"".join(pdf["u"]), np.float32).reshape(len(pdf), -1), axis=0)
        c = centroids(x, max(1, round(len(pdf) / FIT)))
        mass = np.bincount(nearest_cells(x, c, 1)[1], minlength=len(c))
        return pd.DataFrame({"c": [r.tobytes() for r in c], "mass": mass})

    picked = _picked(vectors, FIT * cells / max(1, rows)).select("v").mapInArrow(near, "grp long, u binary")
    made = spread(picked, "grp", len(coarse), FIT * cells * 4 * dim).groupBy("grp").applyInPandas(fit, "c binary, mass long").toPandas()
    if not len(made):
        return coarse, np.ones(len(coarse)), sample
    made = made.sort_values("c")  # in one order, whatever that of the tasks
    c = np.frombuffer(b"".join(made["c"]), np.float32).reshape(len(made), dim)
    return c, made["mass"].to_numpy() * max(1.0, rows / (FIT * cells)), sample


def class_neighbours(vectors: DataFrame, dim: int, rows: int, k: int, at_least: float | None, cell_rows: int, probes: int, max_cells: int = MAX_CELLS) -> DataFrame:
    """a, near array<struct<far, b>>: of each class (its smallest id) the k best other classes, best first; far = -micro."""
    c, mass, sample = fitted(vectors, dim, rows, max(1, min(max_cells, round(rows / cell_rows))))
    root = tight(c, mass, np.inf)  # a crowd is one cell, whatever its size

    def cells_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, cell = nearest_cells(unit, c, probes)
        both = np.unique(row * len(c) + root[cell])
        return both // len(c), both % len(c)

    # classes that a cell will hold: large ones by the small sample with all its cells, others by those nearest to them;
    # dealt into groups if they are too many for a block
    _, one = np.unique(sample.astype(np.float32), axis=0, return_index=True)
    expect = np.bincount(cells_of(sample[one])[1], minlength=len(c)) * (max(rows, len(sample)) / len(sample))
    expect = np.maximum(expect, np.bincount(root, mass, len(c)))
    groups = np.maximum(1, np.ceil(expect / np.clip(expect / COPIES, BLOCK, max(BLOCK, LARGE_BLOCK // 2)))).astype(np.int64)
    # block numbers: cell, then group i <= group j
    base = np.concatenate([[0], np.cumsum(groups * groups)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            if not len(v):
                continue
            ids, unit = batch.column(0).to_numpy(), _unit(v)
            bits = bits_of(unit)
            keys = _keys(bits)
            # copies within the batch travel once, under their smallest id
            order = np.lexsort((ids, keys.view(np.int64).reshape(-1, 2)[:, 1], keys.view(np.int64).reshape(-1, 2)[:, 0]))
            first = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
            row, cell = cells_of(unit[first])
            mark = (keys[first].view(np.uint64).reshape(-1, 2)[:, 0] >> np.uint64(8)).astype(np.int64)[row]
            g = groups[cell]
            mine = mark % g
            row2 = np.repeat(np.arange(len(row)), g)
            other = np.arange(len(row2)) - np.repeat(np.cumsum(g) - g, g)
            lo, hi = np.minimum(mine[row2], other), np.maximum(mine[row2], other)
            part = base[cell[row2]] + lo * g[row2] + hi
            at = row[row2]
            sent = np.ascontiguousarray(bits[first][at])
            blob = pa.Array.from_buffers(pa.binary(sent.shape[1]), len(at), [None, pa.py_buffer(sent)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(ids[first][at]), pa.array(mine[row2].astype(np.int32)), blob],
                names=["part", "id", "grp", "bits"],
            )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)
        # copies from several tasks: the smallest id stands for the class
        _, one, which = np.unique(raw.view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, which, pdf["id"].to_numpy())
        code = np.ascontiguousarray(raw[one, :dim]).view(np.int8)
        rest = np.ascontiguousarray(raw[one, dim:]).view(np.uint16)
        grp = pdf["grp"].to_numpy()[one]
        a, b, micro = block_best(least, code, rest, grp, k, at_least)
        return pd.DataFrame({"a": a, "b": b, "far": -micro})

    blocks = vectors.select("id", "v").mapInArrow(place, "part long, id long, grp int, bits binary")
    # blocks with rows in them: of each cell the pairs of its groups
    n_blocks = int((groups * (groups + 1) // 2)[expect > 0].sum()) or 1
    blocks = spread(blocks, "part", n_blocks, int(expect @ groups) * (3 * dim + 32))
    pairs = blocks.groupBy("part").applyInPandas(join, "a long, b long, far long")
    near = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("far", "b")))), 1, k)
    return pairs.groupBy("a").agg(near.alias("near"))


def most_similar(vectors: DataFrame, dim: int, rows: int, k: int = 5, at_least: float | None = None, cell_rows: int = CELL_ROWS, probes: int = PROBES, max_cells: int = MAX_CELLS) -> DataFrame:
    """id, other, micro, place: of every row of vectors (id, v) its k most similar other rows, at least `at_least` alike.

    micro: the cosine in millionths; place: from 1. rows: the number of rows, or a bound on it. With cell_rows >= rows all
    classes are in one cell and every pair of groups meets: the exact way, at quadratic cost."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            if len(v):
                keys = pa.array(_keys(bits_of(_unit(v))).tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), keys], names=["id", "h"])

    members = checkpointed(vectors.select("id", "v").mapInArrow(name, "id long, h binary").distinct())
    classes = members.groupBy("h").agg(F.min("id").alias("cls"), F.count("*").alias("n"))
    # copies: the k + 1 smallest ids of a class can be among somebody's k best
    firsts = members.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("rn") <= k + 1)
    firsts = firsts.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids")
    near = checkpointed(class_neighbours(vectors, dim, rows, k, at_least, cell_rows, probes, max_cells))
    linked = near.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("cls"), F.col("x.far").alias("far"))
    own = firsts.where(F.size("ids") > 1).select(F.col("cls").alias("a"), F.explode("ids").alias("other"), F.lit(-MICRO).cast("long").alias("far"))
    # a class that many have among their best is dealt; so are the rows of a class of many copies
    liked = hot_keys(linked.groupBy("cls").agg(F.count("*").alias("n")), ["cls"], rows * k)
    others = salted_join(linked, firsts, ["cls"], liked, ["a"]).select("a", F.explode("ids").alias("other"), "far").unionByName(own)
    lists = others.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k + 1).alias("best"))
    of_class = classes.join(lists, F.col("cls") == F.col("a")).select("h", "best")
    copied = hot_keys(classes, ["h"], rows)
    best = salted_join(members, of_class, ["h"], copied, ["id"]).select("id", F.slice(F.filter("best", lambda x: x.other != F.col("id")), 1, k).alias("best"))
    told = best.select("id", F.posexplode("best").alias("p", "x"))
    return told.select("id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("micro"), (F.col("p") + 1).alias("place"))


def pairs_found(best: DataFrame) -> DataFrame:
    """id_a < id_b: the pairs of which one is among the other's best."""
    return best.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


__all__ = ["block_best", "centroids", "class_neighbours", "fitted", "decode", "encode", "most_similar", "pairs_found", "usable"]
