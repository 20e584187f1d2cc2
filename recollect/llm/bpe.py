"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

Texts are cut into words by the vocabulary's pattern. The different words that a partition hasn't met before are
encoded together: an inverted index tells, for each merge, the positions of its token pair in all of these words;
the merges are applied in rank order, each to all of its positions at once, and only the neighbours of a merged pair
are looked at again. A text is then its words' ids in a row. Nothing is shuffled; the words kept per worker are bounded.

Defined cases: a null and an empty text have no ids; special tokens' strings are ordinary text; equal rows each give
a row; an empty table gives an empty result; other columns aren't read; a text's length is bounded by memory only.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_WORDS = 400_000  # words kept per worker; beyond it they are forgotten and encoded anew
KEPT_PAIRS = 2_000_000  # the same of token pairs with what they make
BATCH_CHARS = 8_000_000  # texts whose new words are replayed together


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [x.split() for x in f if x.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.words = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids as int32
        self.pair: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """The token that a and b make, or -1."""
        found = self.pair.get((a, b))
        if found is None:
            found = self.pair[(a, b)] = self.rank.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        token: list[int] = []
        starts: list[int] = []
        ends: set[int] = set()
        for w in words:
            starts.append(len(token))
            token += [self.single[b] for b in w]
            ends.add(len(token) - 1)
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            before[s] = -1
        for e in ends:
            after[e] = -1
        places: dict[int, list[int]] = {}
        merged = self.merged
        for i in range(n):
            if after[i] >= 0 and (r := merged(token[i], token[i + 1])) >= 0:
                places.setdefault(r, []).append(i)
        ranks = list(places)
        heapq.heapify(ranks)
        odd: set[int] = set()  # words in which a merge made a pair of lower rank
        while ranks:
            r = heapq.heappop(ranks)
            at = places.pop(r, None)
            if at is None:
                continue
            at.sort()
            for i in at:
                j = after[i]
                if token[i] < 0 or j < 0 or merged(token[i], token[j]) != r:
                    continue
                token[i], token[j] = r, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := merged(r, token[k])) >= 0:
                        if q not in places:
                            places[q] = []
                            heapq.heappush(ranks, q)
                        places[q].append(i)
                        if q < r:
                            odd.add(bisect_right(starts, i) - 1)
                h = before[i]
                if h >= 0 and (q := merged(token[h], r)) >= 0:
                    if q not in places:
                        places[q] = []
                        heapq.heappush(ranks, q)
                    places[q].append(h)
                    if q < r:
                        odd.add(bisect_right(starts, i) - 1)
        out = []
        for w, s in enumerate(starts):
            if w in odd:
                out.append(self.one_by_one(words[w]))
                continue
            ids = []
            while s >= 0:
                ids.append(token[s])
                s = after[s]
            out.append(ids)
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """The same for one word by its definition: the leftmost pair of the lowest rank, again and again, from a heap."""
        token = [self.single[b] for b in word]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        merged = self.merged
        heap = [(r, i) for i in range(len(token) - 1) if (r := merged(token[i], token[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= len(token) or merged(token[i], token[j]) != r:
                continue  # another merge took one of the two
            token[i], token[j] = r, -1
            k = after[i] = after[j]
            if k < len(token):
                before[k] = i
                if (q := merged(r, token[k])) >= 0:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := merged(token[h], r)) >= 0:
                heapq.heappush(heap, (q, h))
        return [t for t in token if t >= 0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as int32."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.pair) > KEPT_PAIRS:
            self.pair.clear()
        known = self.known
        cut = [self.words(t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(cut)) - known.keys())
        if fresh:
            for w, ids in zip(fresh, self.replay([w.encode() for w in fresh])):
                known[w] = np.array(ids, np.int32).tobytes()
        return [b"".join(map(known.__getitem__, ws)) for ws in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > BATCH_CHARS or k == len(texts) - 1:
            yield ids.slice(at, k + 1 - at), texts[at : k + 1]
            at, size = k + 1, 0


def _read(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encoded(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """doc_id long, ids array<int>: a row for every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for keys, texts in _groups(batch):
                found = v.encode(texts)
                offsets = np.cumsum([0, *map(len, found)]) // 4
                values = np.frombuffer(b"".join(found), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    return _read(df, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def encoded_by_corpus(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """encoded() with the merge replay over the words of the whole corpus: each different word travels once, to the range
    of its hash, the index of a range spans all its words, and texts find their words' ids by a join.

    The same rows. It shuffles every word of every text, which encoded() doesn't (the README has both figures)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for keys, rows, texts in zip([batch.column(0)], [batch.column(1)], [batch.column(2).to_pylist()]):
                words = [v.words(t) if t else [None] for t in texts]  # a text without words keeps its row
                n = np.array([len(w) for w in words], np.int64)
                at = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), rows.take(pa.array(at)), pa.array(place), pa.array(list(chain.from_iterable(words)), pa.string())], names=["doc_id", "row", "place", "word"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            ids = v.replay([w.encode() for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    rows = _read(df, key, text).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    words = rows.mapInArrow(cut, "doc_id long, row long, place long, word string")
    ids = words.select("word").where("word is not null").distinct().mapInArrow(replay, "word string, ids array<int>")
    got = words.join(ids, "word", "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("w"))
    return got.select("doc_id", F.flatten(F.filter(F.transform("w", lambda x: x["ids"]), lambda x: x.isNotNull())).alias("ids"))


def decoded(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of doc_id, ids: the bytes that the ids stand for, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path, pattern).bytes_of
        for batch in batches:
            texts = [b"".join(map(of.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """doc_id long, n_tokens long: a row for every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for keys, texts in _groups(batch):
                sizes = np.array([len(x) // 4 for x in v.encode(texts)], np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes)], names=["doc_id", "n_tokens"])

    return _read(df, key, text).mapInArrow(run, "doc_id long, n_tokens long")
