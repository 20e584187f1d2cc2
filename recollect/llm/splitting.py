"""Splitting of oversized texts at natural boundaries, with overlap, by pointer doubling.

The boundaries are the nodes: sentence and line ends, clause ends, word ends, and every place of a stretch so long without
any that a piece may have to end amid it. A node's successor is the farthest legal end of the next piece, which starts
about `overlap` characters before it: the farthest sentence or line end, else clause end, else word end in the second
half of the room, else the limit itself. The successor table is squared again and again; with each squaring the ends
reached so far give as many new ones, until all texts of a batch have arrived at their ends. All texts of a batch go
through the same array operations; a longer text goes window by window, since no successor lies more than `limit` ahead,
so beside the text a task holds a byte a character and the tables of one window. Rows never leave their partition.

Defined cases: spaces, tabs and line breaks at both ends don't count; null, empty and short texts give no pieces;
lengths are in Unicode code points; a cut without any pause never parts a base character from its combining marks,
unless these alone exceed the room; a repeated row gives its pieces once; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = " \t\r\n"
BATCH_CHARS = 1_000_000  # texts that are cut together, and the window of a longer one
SEPARATOR = 0x110000  # stands at the end of each text
SPACE, LINE, STOP, WIDE_STOP, COMMA, WIDE_COMMA, CLOSER, MARK, JOINER = (1 << k for k in range(9))
WORD, CLAUSE, STRONG, WHOLE, RIM = (1 << k for k in range(5))


@lru_cache(maxsize=1)
def signs() -> np.ndarray:
    """What every code point is, as bits. Fixed values; marks are combining marks, joiners and selectors, which stay with
    the character before."""
    table = np.zeros(SEPARATOR + 1, np.uint16)
    for bit, held in (
        (SPACE, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]),
        (LINE, [10, 13, 0x85, 0x2028, 0x2029]),
        (STOP, map(ord, ".!?…؟۔।")),  # end a sentence before white space
        (WIDE_STOP, map(ord, "。！？｡")),  # end it anywhere
        (COMMA, map(ord, ",;:،؛–—")),
        (WIDE_COMMA, map(ord, "，、；：")),
        (CLOSER, map(ord, "\"')]}»”’」』）】")),
        (MARK, [*range(0x300, 0x370), *range(0x64B, 0x660), 0x200D, *range(0xFE00, 0xFE10), *range(0x1F3FB, 0x1F400)]),
        (JOINER, [0x200D]),
    ):
        table[list(held)] |= bit
    return table


def _last_where(mask: np.ndarray) -> np.ndarray:
    """For every position the last one up to it with mask, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def boundaries(c: np.ndarray, block: int = BATCH_CHARS) -> np.ndarray:
    """What may end before each position of the code points c, as bits; block by block, a few signs carried over."""
    out = np.zeros(len(c), np.uint8)
    carry = np.zeros(0, c.dtype)
    for at in range(0, len(c), block):
        x = np.concatenate([carry, c[at : at + block]])
        t = signs()[x]
        behind = np.concatenate([[0], t[:-1]])
        space, closer = t & SPACE != 0, t & CLOSER != 0
        # the last sign before the white space, closing quotes skipped; the separator is a sign, so texts don't mix
        of_sign, of_solid, of_line = _last_where(~space & ~closer), _last_where(~space), _last_where(t & LINE != 0)
        step = lambda v: np.concatenate([[-1], v[:-1]])
        sign, solid, line = step(of_sign), step(of_solid), step(of_line)
        before = t[np.maximum(0, sign)]
        word = (behind & SPACE != 0) & ~space
        wide = ~space & ~closer
        strong = word & ((line > solid) | (before & STOP != 0)) | wide & (before & WIDE_STOP != 0)
        clause = word & (before & COMMA != 0) | wide & (before & WIDE_COMMA != 0)
        whole = (t & MARK == 0) & (behind & JOINER == 0)
        made = word * WORD + clause * CLAUSE + strong * STRONG + whole * WHOLE
        out[at : at + block] = made[len(carry) :]
        # what the next block has to know: the last sign, a closer and a line break behind it, and the last character
        keep = {max(0, int(of_sign[-1])), max(0, int(of_solid[-1])), len(x) - 1}
        if of_line[-1] > of_solid[-1]:
            keep.add(int(of_line[-1]))
        carry = x[sorted(keep)]
    out[c == SEPARATOR] = RIM
    out[0] = RIM
    out[1:][c[:-1] == SEPARATOR] = RIM
    return out


def ends_of(texts: list[str], limit: int, overlap: int, window: int = BATCH_CHARS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, longer than limit, the starts and ends of its pieces."""
    size = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size + 1)])
    c = np.full(base[-1], SEPARATOR, np.uint32)
    for b, t in zip(base, texts):
        c[b : b + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = boundaries(c, window)
    del c
    slack = overlap // 4
    room = limit - max(limit // 2, overlap + slack + 1)  # a stretch so long without a boundary may be cut anywhere
    starts, ends = [], []
    at, entry = 0, base[:-1]
    while True:
        stop = len(kind) if len(kind) - at <= window + limit else at + window
        low = max(0, at - overlap - 2 * slack - limit)
        near = kind[low:stop]
        edge = np.flatnonzero(near & (WORD | CLAUSE | STRONG | RIM)) + low  # boundaries, first and last places
        wall = np.concatenate([[low - 1], edge, [stop]])
        amid = [np.arange(wall[k] + 1, wall[k + 1]) for k in np.flatnonzero(np.diff(wall) >= room)]
        node = np.unique(np.concatenate([edge, *amid, [stop - 1]]))
        node = node[node >= at]
        text = np.searchsorted(base, node, "right") - 1
        first, last = base[text], base[text] + size[text]

        def far(bit: int, where: np.ndarray) -> np.ndarray:
            places = np.flatnonzero(near & bit) + low
            k = np.searchsorted(places, where, "right") - 1
            return np.where(k >= 0, places[np.maximum(0, k)] if len(places) else -1, -1)

        def whole(where: np.ndarray, least: np.ndarray) -> np.ndarray:
            """The last place up to `where` that parts no character, not below `least`, or -1."""
            p = where.copy()
            todo = np.flatnonzero(kind[p] & WHOLE == 0)
            while len(todo):
                p[todo] -= 1
                todo = todo[(p[todo] >= least[todo]) & (kind[np.maximum(0, p[todo])] & WHOLE == 0)]
            return np.where(p >= least, p, -1)

        # where the next piece starts if one ends here: a word near the overlap, else the overlap itself
        goal = node - overlap
        left, right = far(WORD, np.maximum(0, goal)), far(WORD, np.maximum(0, goal + slack))
        close = np.where(left >= goal - slack, left, right)
        start = np.where((close >= goal - slack) & (close > first) & (goal > first), close, np.maximum(first, goal))
        held = whole(start, np.maximum(first + 1, start - slack + 1))
        held = np.where((held < 0) & (start - slack < first), first, held)
        start = np.where(held >= 0, held, start)
        start = np.where(node == first, first, start)

        reach = np.minimum(start + limit, last)
        floor = np.maximum(node + 1, start + limit // 2)
        nxt = np.full(len(node), -1)
        clipped = np.minimum(reach, stop - 1)
        for bit in (STRONG, CLAUSE, WORD):
            p = far(bit, clipped)
            nxt = np.where((nxt < 0) & (p >= floor), p, nxt)
        rest = np.flatnonzero(nxt < 0)
        nxt[rest] = whole(clipped[rest], floor[rest])
        nxt = np.where(nxt < 0, clipped, nxt)
        nxt = np.where(start + limit >= last, last, nxt)
        open_ = (node + limit >= stop) & (stop < len(kind))  # the next window knows where these go on
        nxt = np.where((node == last) | open_, node, nxt)

        jump = np.minimum(np.searchsorted(node, nxt), len(node) - 1)
        found = np.unique(np.searchsorted(node, entry))
        known = 0
        while known < len(found):
            known = len(found)
            found = np.unique(np.concatenate([found, jump[found]]))
            jump = jump[jump]
        on = found[~((node[found] == last[found]) | open_[found])]  # a piece starts behind each of these
        starts.append(start[on])
        ends.append(nxt[on])
        if stop == len(kind):
            break
        at = int(node[found[-1]])
        entry = np.array([at])
    s, e = np.concatenate(starts), np.concatenate(ends)
    cuts = np.searchsorted(e, base, "right")  # a piece ends behind its text's first place, at its last one or before
    return [(s[a:b] - base[k], e[a:b] - base[k]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def pieces(df: DataFrame, key: str, text: str, limit: int = 800, overlap: int = 100) -> DataFrame:
    """row_id, piece_no (from 1), start, end (in the trimmed text), piece: of every text longer than limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    trimmed = df.select(F.col(key).cast("long").alias("row_id"), F.trim(F.col(text), F.lit(EDGE)).alias("body"))
    long = trimmed.where(F.length("body") > limit).withColumn("h", F.xxhash64("body")).dropDuplicates(["row_id", "h"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids, bodies = pdf["row_id"].to_numpy(), pdf["body"].tolist()
            a = 0
            while a < len(bodies):
                b, chars = a, 0
                while b < len(bodies) and (b == a or chars + len(bodies[b]) <= BATCH_CHARS):
                    chars += len(bodies[b])
                    b += 1
                cols = {"row_id": [], "piece_no": [], "start": [], "end": [], "piece": []}
                for i, (s, e) in enumerate(ends_of(bodies[a:b], limit, overlap)):
                    body = bodies[a + i]
                    cols["row_id"] += [ids[a + i]] * len(s)
                    cols["piece_no"] += range(1, len(s) + 1)
                    cols["start"] += s.tolist()
                    cols["end"] += e.tolist()
                    cols["piece"] += [body[x:y] for x, y in zip(s, e)]
                yield pd.DataFrame(cols)
                a = b

    return long.select("row_id", "body").mapInPandas(run, "row_id long, piece_no int, start int, end int, piece string")
