"""Ordered passes over groups that may be larger than memory.

Rows of a group go to one task in order, batch by batch; a kernel sees one piece at a time and keeps only its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, schema: str, finish: Callable | None = None, gather: int = 0) -> DataFrame:
    """start() makes the state of a group; step(state, piece) gives rows; finish(state, keys) gives the last ones.

    gather: rows to put together before they are handed on, where many groups give a few each; their columns must then be
    of the same kinds each time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, None
        for pdf in parts:
            if pdf.empty:
                continue
            k = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            change = np.r_[True, (k.iloc[1:].to_numpy() != k.iloc[:-1].to_numpy()).any(1)]
            heads = np.r_[np.flatnonzero(change), len(pdf)]
            for a, b in zip(heads, heads[1:]):
                key = tuple(k.iloc[a])
                if key != at:
                    if at is not None and finish is not None and (out := finish(state, at)) is not None and len(out):
                        yield out
                    state, at = start(), key
                out = step(state, pdf.iloc[a:b])
                if out is not None and len(out):
                    yield out
        if at is not None and finish is not None and (out := finish(state, at)) is not None and len(out):
            yield out

    def gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for out in run(parts):
            held.append(out)
            n += len(out)
            if n >= gather:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    # by a new column: a planner that takes the input for already parted by the keys (as it may a union) can't leave this out
    dealt = df.withColumn("_deal", F.xxhash64(*keys)).repartition("_deal").sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(gathered if gather else run, schema)
