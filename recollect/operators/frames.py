"""Frame selection: slots, still pictures, near-duplicates, pacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.streams import in_order

DARK, BRIGHT, BLUR, DIFF, HIST, SLOT = 25.0, 235.0, 60.0, 6.0, 0.10, 9
HASH_MAX, COSINE_MIN = 6, 0.95


def first_reason(brightness: Column, sharpness: Column, diff: Column | None = None, change: Column | None = None) -> Column:
    """dark, bright, blurry or still, the first that holds; null to keep. still takes both a small difference and a small
    change of the histogram; without a previous picture (null) nothing is still."""
    r = F.when(brightness < DARK, "dark").when(brightness > BRIGHT, "bright").when(sharpness < BLUR, "blurry")
    return r if diff is None else r.when((diff < DIFF) & (change < HIST), "still")


def slot_reasons(frames: DataFrame, size: int = SLOT) -> DataFrame:
    """frames: video_id, frame_no, brightness, sharpness -> the same with slot and reason (null for the slot's kept frame).

    A slot is `size` consecutive frame numbers; its sharpest frame that is neither dark nor bright stays unless blurry."""
    b = F.when(F.col("brightness") < DARK, "dark").when(F.col("brightness") > BRIGHT, "bright")
    f = frames.withColumns({"slot": F.floor(F.col("frame_no") / size), "fault": b})
    usable = f.where(F.col("fault").isNull() & F.col("sharpness").isNotNull())
    best = usable.groupBy("video_id", "slot").agg(F.max(F.struct("sharpness", -F.col("frame_no"))).alias("top"))
    j = f.join(best, ["video_id", "slot"], "left")
    mine = -F.col("top.col2") == F.col("frame_no")
    reason = F.coalesce("fault", F.when(mine, first_reason(F.col("brightness"), F.col("sharpness"))).otherwise("less sharp"))
    return j.withColumn("reason", reason).drop("top", "fault")


def still_filter(slots: DataFrame) -> DataFrame:
    """slots: video_id, frame_no, pixels array<int>, width, height of the frames that slots kept -> video_id, frame_no, reason.

    Each is compared with the last frame that was kept before it in its video."""
    from recollect.functions.pictures import hist_change, mean_abs_diff

    def start() -> dict:
        return {"last": None}

    def step(state: dict, piece: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v, n, px, w, h in zip(piece["video_id"], piece["frame_no"], piece["pixels"], piece["width"], piece["height"]):
            now = (np.asarray(px, np.int64), w, h)
            last = state["last"]
            still = last is not None and last[1:] == now[1:] and mean_abs_diff(last[0], now[0]) < DIFF and hist_change(last[0], now[0]) < HIST
            if not still:
                state["last"] = now
            out.append((v, n, "still" if still else None))
        return pd.DataFrame(out, columns=["video_id", "frame_no", "reason"])

    return in_order(slots.select("video_id", "frame_no", "pixels", "width", "height"), ["video_id"], ["frame_no"], start, step, "video_id string, frame_no long, reason string")


def dedup(frames: DataFrame, hash_max: int = HASH_MAX, cosine_min: float = COSINE_MIN) -> DataFrame:
    """frames: video_id, frame_no, hash long, v -> video_id, frame_no, duplicate_of (null for a new look).

    A frame repeats the earlier new look with the nearest hash if at most `hash_max` bits differ, else the most alike one
    if alike enough; of equals the first. A missing hash or vector takes no part in its test. Only new looks are kept
    in memory, so a video may have any number of frames."""

    def start() -> dict:
        return {"no": np.zeros(64, np.int64), "h": np.zeros(64, np.uint64), "has": np.zeros(64, bool), "v": None, "n": 0}

    def grow(s: dict, dim: int) -> None:
        if s["v"] is None and dim:
            s["v"] = np.zeros((len(s["no"]), dim))
        if s["n"] == len(s["no"]):
            for c in ("no", "h", "has"):
                s[c] = np.concatenate([s[c], np.zeros_like(s[c])])
            if s["v"] is not None:
                s["v"] = np.concatenate([s["v"], np.zeros_like(s["v"])])

    def step(s: dict, piece: pd.DataFrame) -> pd.DataFrame:
        out = []
        for video, no, h, v in zip(piece["video_id"], piece["frame_no"], piece["hash"], piece["v"]):
            of, n = None, s["n"]
            h = None if h is None or pd.isna(h) else np.uint64(int(h) & 0xFFFFFFFFFFFFFFFF)
            vec = None if v is None else np.asarray(v, float)
            if n and h is not None and s["has"][:n].any():
                d = np.where(s["has"][:n], np.bitwise_count(s["h"][:n] ^ h), 99)
                if d.min() <= hash_max:
                    of = int(s["no"][d.argmin()])
            if of is None and n and vec is not None and s["v"] is not None:
                c = s["v"][:n] @ vec
                if c.max() >= cosine_min:
                    of = int(s["no"][c.argmax()])
            if of is None:
                grow(s, 0 if vec is None else len(vec))
                s["no"][n], s["has"][n] = no, h is not None
                if h is not None:
                    s["h"][n] = h
                if vec is not None:
                    s["v"][n] = vec
                s["n"] = n + 1
            out.append((video, no, of))
        return pd.DataFrame(out, columns=["video_id", "frame_no", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    return in_order(frames.select("video_id", "frame_no", "hash", "v"), ["video_id"], ["frame_no"], start, step, "video_id string, frame_no long, duplicate_of long")


def motion_paced(frames: DataFrame, budget: float, max_gap: int) -> DataFrame:
    """frames: video_id, frame_no, motion, sharpness -> the sharpest frame of each stretch: video_id, frame_no, segment.

    A stretch ends when its motion reaches `budget`, after `max_gap` frames, or at the video's end."""

    def start() -> dict:
        return {"moved": 0.0, "n": 0, "best": None, "segment": 0}

    def step(s: dict, piece: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v, no, m, sharp in zip(piece["video_id"], piece["frame_no"], piece["motion"], piece["sharpness"]):
            s["moved"] += 0.0 if pd.isna(m) else m
            s["n"] += 1
            if s["best"] is None or sharp > s["best"][0]:
                s["best"] = (sharp, no)
            if s["moved"] >= budget or s["n"] >= max_gap:
                out.append((v, s["best"][1], s["segment"]))
                s.update(moved=0.0, n=0, best=None, segment=s["segment"] + 1)
        return pd.DataFrame(out, columns=["video_id", "frame_no", "segment"])

    def finish(s: dict, key: tuple) -> pd.DataFrame | None:
        return None if s["best"] is None else pd.DataFrame([(key[0], s["best"][1], s["segment"])], columns=["video_id", "frame_no", "segment"])

    return in_order(frames.select("video_id", "frame_no", "motion", "sharpness"), ["video_id"], ["frame_no"], start, step, "video_id string, frame_no long, segment long", finish)


def spaced(counts: DataFrame, n: int) -> DataFrame:
    """counts: video_id, total -> video_id, slot, a, b, middle: n slots [a, b) with edges rounded half to even."""
    e = lambda i: F.bround(i * F.col("total") / n).cast("long")
    s = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    s = s.withColumns({"a": e(F.col("slot")), "b": e(F.col("slot") + 1)})
    return s.withColumn("middle", F.least(F.col("total") - 1, F.floor((F.col("a") + F.col("b")) / 2)).cast("long"))


def uniform_times(videos: DataFrame, n: int) -> DataFrame:
    """videos: video_id, duration_s -> video_id, i, t: n evenly spread times."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    return videos.where("duration_s > 0").select("video_id", "duration_s", i).select("video_id", "i", ((F.col("i") + 0.5) * F.col("duration_s") / n).alias("t"))


def frame_times(videos: DataFrame, fps: float) -> DataFrame:
    """videos: video_id, duration_s -> video_id, i, t of every frame; none for a missing, NaN or non-positive duration."""
    n = F.ceil(F.col("duration_s") * fps - 1e-6).cast("long")
    ok = videos.where((F.col("duration_s") > 0) & ~F.isnan("duration_s") & (n > 0))
    return ok.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).withColumn("t", F.col("i") / fps)


def interval_times(videos: DataFrame, every: float) -> DataFrame:
    """videos: video_id, duration_s -> video_id, i, t: a frame every `every` seconds with both ends.

    The last one lies at the video's end if more than a fifth of the interval is left. A duration of 0 gives the frame at
    0; a missing, NaN or negative one none."""
    d = F.col("duration_s")
    ok = videos.where((d >= 0) & ~F.isnan(d) & (d < float("inf")))
    n = F.floor((d + 0.01) / every).cast("long")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: k * F.lit(float(every)))
    times = F.when(d - n * every > every * 0.2, F.concat(steps, F.array(d))).otherwise(steps)
    return ok.select("video_id", F.posexplode(times).alias("i", "t"))


def sharpest_spaced(frames: DataFrame, n: int) -> DataFrame:
    """frames: video_id, frame_no, sharpness -> video_id, slot, frame_no: the sharpest frame of each of n equal slots of a video's
    frames in order (the edges as in spaced(); an empty slot takes the frame at its edge), the first of equals."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    f = frames.select("video_id", "frame_no", F.coalesce("sharpness", F.lit(float("-inf"))).alias("sharpness")).withColumn("at", F.row_number().over(w) - 1)
    s = spaced(f.groupBy("video_id").agg(F.count("*").alias("total")), n).select("video_id", "slot", "a", F.greatest("b", F.col("a") + 1).alias("b"))
    j = f.join(s, "video_id").where((F.col("at") >= F.col("a")) & (F.col("at") < F.col("b"))).select("video_id", "slot", "frame_no", "sharpness")
    return j.groupBy("video_id", "slot").agg(F.min_by("frame_no", F.struct(-F.col("sharpness"), "frame_no")).alias("frame_no"))


class _Rules:
    """Up to 64 settings as the bits of a word."""

    def __init__(self, settings: list[dict]):
        one = lambda on: sum(1 << k for k, p in enumerate(settings) if on(p))
        self.settings, self.places = settings, np.arange(len(settings), dtype=np.uint64)
        self.near = np.array([one(lambda p: d <= p["hash_max"]) for d in range(65)], np.uint64)  # settings that d differing bits satisfy
        self.wide, self.top = self.near[1], max(p["hash_max"] for p in settings)
        self.least = min(p["cos_min"] for p in settings)
        self.levels = [(c, np.uint64(one(lambda p: p["cos_min"] <= c))) for c in sorted({p["cos_min"] for p in settings})]

    def alike(self, s: np.ndarray) -> np.ndarray:
        """The settings that each cosine satisfies."""
        out = np.zeros(s.shape, np.uint64)
        for c, some in self.levels:
            out[s >= c] = some
        return out

    def fine(self, bright: np.ndarray, sharp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bright), np.uint64)
        for k, p in enumerate(self.settings):
            out |= ((bright >= p["dark"]) & (bright <= p["bright"]) & (sharp >= p["blur"])).astype(np.uint64) << np.uint64(k)
        return out

    def count(self, words: np.ndarray) -> np.ndarray:
        return ((words[:, None] >> self.places) & np.uint64(1)).sum(0, dtype=np.int64)


class _Looks:
    """Kept looks of a video under up to 64 settings at once: each with the settings that keep it as the bits of a word.

    Frames come in blocks: one matrix step asks all looks kept before, then the block goes frame by frame over what is near
    within it. Equal hashes are looked up; only settings that allow differing bits compare hashes at all."""

    ROWS, COLUMNS, TILE = 256, 4096, 16  # frames of a block; of those TILE at once against so many looks, which the cache holds

    def __init__(self, rules: _Rules):
        self.rules = rules
        self.equal: dict[int, int] = {}
        self.codes, self.codes_of = np.zeros(64, np.uint64), np.zeros(64, np.uint64)
        self.vectors, self.vectors_of = None, np.zeros(64, np.uint64)
        self.n, self.m = 0, 0
        self.bits, self.d = np.empty((self.TILE, self.COLUMNS), np.uint64), np.empty((self.TILE, self.COLUMNS), np.uint8)
        self.kept, self.calls = np.zeros(len(rules.settings), np.int64), np.zeros(len(rules.settings), np.int64)

    def _near(self, x: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The settings with a kept hash near each of x, of those that it needs to know about."""
        out = np.array([self.equal.get(c, 0) for c in x.tolist()], np.uint64) & self.rules.near[0]
        for a in range(0, self.n, self.COLUMNS):
            rows = np.flatnonzero(need & self.rules.wide & ~out)
            if not len(rows):
                break
            some, of = self.codes[a : min(self.n, a + self.COLUMNS)], self.codes_of[a : min(self.n, a + self.COLUMNS)]
            for b in range(0, len(rows), self.TILE):
                at = rows[b : b + self.TILE]
                bits, d = self.bits[: len(at), : len(some)], self.d[: len(at), : len(some)]
                np.bitwise_count(np.bitwise_xor(x[at, None], some, out=bits), out=d)
                if d.min() <= self.rules.top:
                    hit = d.min(1) <= self.rules.top
                    out[at[hit]] |= np.bitwise_or.reduce(self.rules.near[d[hit]] & of, axis=1)
        return out

    def _alike(self, x: np.ndarray, need: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for a in range(0, self.m, self.COLUMNS):
            rows = np.flatnonzero(need & ~out)
            if not len(rows):
                break
            s = x[rows] @ self.vectors[a : min(self.m, a + self.COLUMNS)].T
            some = (s >= self.rules.least).any(1)
            if some.any():
                out[rows[some]] |= np.bitwise_or.reduce(self.rules.alike(s[some]) & self.vectors_of[a : a + s.shape[1]], axis=1)
        return out

    def add(self, bright: np.ndarray, sharp: np.ndarray, code: np.ndarray, coded: np.ndarray, vectors: np.ndarray) -> None:
        """Frames in order; coded: whether there is a hash; vectors: an object each, None if missing."""
        fine = self.rules.fine(bright, sharp)
        rows = np.flatnonzero(fine)
        for a in range(0, len(rows), self.ROWS):
            at = rows[a : a + self.ROWS]
            self._block(fine[at], code[at], coded[at], vectors[at])

    def _block(self, fine: np.ndarray, code: np.ndarray, coded: np.ndarray, vectors: np.ndarray) -> None:
        n = len(fine)
        before = np.arange(n)[:, None] > np.arange(n)
        near = np.zeros(n, np.uint64)
        near[coded] = self._near(code[coded], fine[coded])
        d = np.bitwise_count(code[:, None] ^ code)
        close = (d <= self.rules.top) & before & coded & coded[:, None]
        some_close = close.any(1)
        with_v = np.array([v is not None for v in vectors], bool)
        place = np.cumsum(with_v) - 1
        alike, some_alike = np.zeros(n, np.uint64), np.zeros(n, bool)
        if with_v.any():
            x = np.array([np.asarray(v, float) for v in vectors[with_v]])
            alike[with_v] = self._alike(x, (fine & ~near)[with_v])
            s = x @ x.T
            some_alike[with_v] = ((s >= self.rules.least) & before[: len(x), : len(x)]).any(1)
        asked, kept = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(n):
            near_i = near[i]
            if some_close[i]:
                j = np.flatnonzero(close[i])
                near_i |= np.bitwise_or.reduce(self.rules.near[d[i, j]] & kept[j])
            asked[i] = fine[i] & ~near_i
            alike_i = alike[i]
            if some_alike[i] and asked[i]:
                alike_i |= np.bitwise_or.reduce(self.rules.alike(s[place[i], : place[i]]) & kept[:i][with_v[:i]])
            kept[i] = asked[i] & ~alike_i
        self.calls += self.rules.count(asked)
        self.kept += self.rules.count(kept)
        for c, b in zip(code[coded].tolist(), kept[coded].tolist()):
            if b:
                self.equal[c] = self.equal.get(c, 0) | b
        new = coded & ((kept & self.rules.wide) > 0)
        self.codes, self.codes_of, self.n = self._put(self.codes, self.codes_of, self.n, code[new], kept[new] & self.rules.wide)
        if with_v.any():
            if self.vectors is None:
                self.vectors = np.zeros((64, x.shape[1]))
            new = kept[with_v] > 0
            self.vectors, self.vectors_of, self.m = self._put(self.vectors, self.vectors_of, self.m, x[new], kept[with_v][new])

    @staticmethod
    def _put(have: np.ndarray, of: np.ndarray, n: int, new: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        while n + len(new) > len(have):
            have, of = np.concatenate([have, np.zeros_like(have)]), np.concatenate([of, np.zeros_like(of)])
        have[n : n + len(new)], of[n : n + len(new)] = new, bits
        return have, of, n + len(new)


def dedup_grid(frames: DataFrame, settings: list[dict]) -> DataFrame:
    """frames: video_id, frame_no, brightness, sharpness, hash, v -> video_id, setting, kept, calls: for every setting (dark,
    bright, blur, hash_max, cos_min) the frames that stay and how many of them the vectors had to be asked about.

    The tuning form of the de-duplication: no slots; a frame goes if any kept hash is near enough, else if any kept
    vector is. All settings are judged in one ordered pass over a video, each with its own kept looks; a look that several
    settings keep is held and compared once."""

    rules = [_Rules(settings[a : a + 64]) for a in range(0, len(settings), 64)]

    def start() -> list[_Looks]:
        return [_Looks(r) for r in rules]

    def step(state: list[_Looks], piece: pd.DataFrame) -> None:
        bright, sharp = (piece[c].to_numpy(np.float64, na_value=np.nan) for c in ("brightness", "sharpness"))
        code = piece["hash"].to_numpy(np.int64).view(np.uint64)
        for looks in state:
            looks.add(bright, sharp, code, piece["coded"].to_numpy(bool), piece["v"].to_numpy())

    def finish(state: list[_Looks], key: tuple) -> pd.DataFrame:
        kept, calls = (np.concatenate([getattr(x, c) for x in state]) for c in ("kept", "calls"))
        return pd.DataFrame({"video_id": key[0], "setting": np.arange(len(settings), dtype=np.int32), "kept": kept, "calls": calls})

    # a missing hash as 0 beside a flag: 64 bits don't survive a column of numbers with gaps
    cols = frames.select("video_id", "frame_no", "brightness", "sharpness", F.coalesce("hash", F.lit(0).cast("long")).alias("hash"), F.col("hash").isNotNull().alias("coded"), "v")
    return in_order(cols, ["video_id"], ["frame_no"], start, step, "video_id string, setting int, kept long, calls long", finish, gather=10_000)
