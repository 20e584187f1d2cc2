"""Points inside outlines: edges and points swept together along the longitude."""

from __future__ import annotations

import numpy as np

FAR_NORTH = 91.0  # degrees


def ring_edges(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Edges (lon0, lat0, lon1, lat1) with lon0 < lon1 over [-180, 180), and the pole the ring holds: 1 north, -1 south, 0 none.

    Edges are straight in degrees and run the shorter way round. None: fewer than three corners, or no finite ones."""
    if len(lat) and (lat[0], lon[0]) == (lat[-1], lon[-1]):
        lat, lon = lat[:-1], lon[:-1]
    if len(lat) < 3 or not (np.isfinite(lat).all() and np.isfinite(lon).all()):
        return None
    lon = (lon + 180.0) % 360.0 - 180.0
    to_lat, to_lon = np.roll(lat, -1), np.roll(lon, -1)
    # turns that bring the next corner within half a turn; corners keep their exact longitude, which neighbours share
    turn = np.where(to_lon - lon > 180.0, -1, np.where(to_lon - lon < -180.0, 1, 0))
    over = turn != 0
    first = np.stack([lon, lat, to_lon + 360.0 * turn, to_lat], axis=1)
    second = np.stack([lon - 360.0 * turn, lat, to_lon, to_lat], axis=1)[over]
    e = np.concatenate([first, second])
    e = e[e[:, 0] != e[:, 2]]
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1]]
    # a ring whose turns don't cancel out runs round a pole: the one on its side of the equator
    pole = (1 if lat.mean() > 0 else -1) if turn.sum() else 0
    return e, pole


def clipped(edges: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The edges that can lie north of a point of the cell low <= (lon, lat) < high.

    Those wholly north of the cell count by their longitudes only: they become flat edges where an odd number of them lies
    above one another, so the far side of a ring of many corners is a few edges."""
    top, bottom = edges[:, [1, 3]].max(1), edges[:, [1, 3]].min(1)
    near = (edges[:, 2] > low[0]) & (edges[:, 0] < high[0]) & (top > low[1])
    north = near & (bottom >= high[1])
    ends, n = np.unique(edges[north][:, [0, 2]], return_counts=True)
    odd = ends[n % 2 == 1].reshape(-1, 2)
    flat = np.stack([odd[:, 0], np.full(len(odd), FAR_NORTH), odd[:, 1], np.full(len(odd), FAR_NORTH)], axis=1)
    flat = flat[(flat[:, 2] > low[0]) & (flat[:, 0] < high[0])]
    return np.concatenate([edges[near & ~north], flat])


def inside(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray, owner: np.ndarray, flip: np.ndarray, step: int = 2_000_000):
    """(point, owner) pairs, the point inside the owner's ring: an odd number of its edges lies north of the point.

    edges: as from ring_edges, of all rings; owner: the ring of each edge, from 0; flip: by ring, true if it holds the
    north pole. The sweep goes east through the strips between neighbouring edge ends; within one the active edges are
    the same for all points. Points are unequal in number by strip, so a strip's points are taken in pieces."""
    at_p, at_o = [], []
    lon = (lon + 180.0) % 360.0 - 180.0
    order = np.argsort(lon, kind="stable")
    xs, ys = lon[order], lat[order]
    stops = np.unique(edges[:, [0, 2]])
    first = np.searchsorted(xs, stops, "left")  # points at a stop belong to the strip that starts there
    opens, closes = np.argsort(edges[:, 0], kind="stable"), np.argsort(edges[:, 2], kind="stable")
    o_at = np.searchsorted(edges[opens, 0], stops, "right")
    c_at = np.searchsorted(edges[closes, 2], stops, "right")
    active = np.zeros(len(edges), bool)
    seen_o = seen_c = 0
    flipped = np.flatnonzero(flip)
    if len(flipped):  # a ring round the pole spans all longitudes; every point starts inside of it
        odd = {int(r): np.ones(len(lat), bool) for r in flipped}
    else:
        odd = {}
    for k in range(len(stops) - 1):
        a, b = first[k], first[k + 1]
        if a == b:
            continue
        active[opens[seen_o : o_at[k]]] = True
        seen_o = o_at[k]
        active[closes[seen_c : c_at[k]]] = False
        seen_c = c_at[k]
        live = np.flatnonzero(active)
        if not len(live):
            continue
        e, ring = edges[live], owner[live]
        by = np.argsort(ring, kind="stable")
        e, ring = e[by], ring[by]
        heads = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
        slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        piece = max(1, step // len(e))
        for p in range(a, b, piece):
            q = min(b, p + piece)
            north = e[:, 1] + (xs[p:q, None] - e[:, 0]) * slope > ys[p:q, None]
            parity = np.add.reduceat(north, heads, axis=1, dtype=np.int64) % 2 == 1
            who, which = np.nonzero(parity)
            rings = ring[heads][which]
            pts = order[p:q][who]
            for r in odd:
                odd[r][pts[rings == r]] ^= True
            keep = ~flip[rings]
            at_p.append(pts[keep])
            at_o.append(rings[keep])
    for r, held in odd.items():
        pts = np.flatnonzero(held)
        at_p.append(pts)
        at_o.append(np.full(len(pts), r))
    return (np.concatenate(at_p), np.concatenate(at_o)) if at_p else (np.zeros(0, int), np.zeros(0, int))
