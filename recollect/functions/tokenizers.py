"""Token ids by public tokenizers, as Arrow-batched functions. The file's path is a parameter; each worker loads it once."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _loaded(path: str):
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: p.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def token_ids(text: Column, path: str, start: int | None = None, end: int | None = None, most: int | None = None) -> Column:
    """array<int>: a null text has none. With start and end around, and at most `most` in all, as models want them."""

    def run(texts: pd.Series) -> pd.Series:
        found = _loaded(path)(["" if t is None else t for t in texts])
        room = None if most is None else most - (start is not None) - (end is not None)
        edge = lambda x: [] if x is None else [x]
        return pd.Series([edge(start) + list(i[:room]) + edge(end) if t is not None else [] for t, i in zip(texts, found)], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)
