"""Retrieval: dense, keyword and hybrid ranking. docs: id, text, v. A query vector is a one-row DataFrame with column q.

Every ranking breaks ties by id. Scoring is a scan; only the `pool` best rows of a ranking are sorted and joined."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import ascii_words, tokens
from recollect.functions.vectors import doubles, dot, dot_or_zero

POOL, TOP = 20, 5
K1, B = 1.2, 0.75


def best(df: DataFrame, score: Column | str, k: int, *ties: Column) -> DataFrame:
    """The k best rows with their rank (from 0): score descending, then ties, then id."""
    s = F.col(score) if isinstance(score, str) else score
    order = [s.desc(), *ties, F.col("id")]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def dense(docs: DataFrame, query: DataFrame, strict: bool = True) -> DataFrame:
    """id, score of every row with a vector. strict=False: vectors of another size score 0."""
    like = dot if strict else dot_or_zero
    scored = docs.where(F.size("v") > 0).crossJoin(F.broadcast(query.limit(1))).select("id", like(F.col("v"), F.col("q")).alias("score"))
    return scored.where(F.col("score").isNotNull())


def _times(terms: str, word: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == word))


def bm25(docs: DataFrame, words: list[str], plus_one: bool = False, term: Callable[[Column], Column] = tokens) -> DataFrame:
    """id, score of the rows with at least one of the words; a repeated query word counts again.

    plus_one: idf = ln(1 + x), else ln(x), and a millionth where that isn't positive."""
    if not words:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    kinds = list(dict.fromkeys(words))
    cut = docs.where(F.col("text").isNotNull()).select("id", term(F.col("text")).alias("t"))
    counted = cut.select("id", F.size("t").alias("dl"), *[_times("t", w).alias(f"tf{i}") for i, w in enumerate(kinds)])
    held = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(kinds))])
    score = F.lit(0.0)
    for w in words:
        i = kinds.index(w)
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        x = (F.col("n") - df + 0.5) / (df + 0.5)
        idf = F.log(1 + x) if plus_one else F.when(x > 1, F.log(x)).otherwise(1e-6)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg")))).otherwise(0.0)
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(kinds))]) if len(kinds) > 1 else F.col("tf0")
    return counted.where(some > 0).crossJoin(F.broadcast(held)).select("id", score.alias("score"))


def prefix_hits(docs: DataFrame, words: list[str], limit: int = POOL) -> DataFrame:
    """id, rank of the first `limit` rows by id in which some token begins with one of the words."""
    if not words:
        return docs.select("id", F.lit(0).alias("rank")).limit(0)
    t = tokens(F.col("text"))
    hit = F.exists(t, lambda x: F.greatest(*[x.startswith(w) for w in words]) if len(words) > 1 else x.startswith(words[0]))
    first = docs.where(hit).select("id").orderBy("id").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("long") - 1)


def fuse_common_first(d: DataFrame, s: DataFrame, offset: int = 61) -> DataFrame:
    """d, s: id, rank. Rows of both lists come first by the sum of 1/(offset + rank), then the rest by their own."""
    j = d.select("id", F.col("rank").alias("rd")).join(s.select("id", F.col("rank").alias("rs")), "id", "full_outer")
    both = F.col("rd").isNotNull() & F.col("rs").isNotNull()
    part = lambda c: F.coalesce(1.0 / (offset + F.col(c)), F.lit(0.0))
    scored = j.withColumns({"score": part("rd") + part("rs"), "common": both.cast("int"), "source": F.when(F.col("rd").isNotNull(), 0).otherwise(1)})
    order = [F.desc("common"), F.desc("score"), "source", F.coalesce("rd", "rs"), "id"]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def fuse_sum(lists: list[DataFrame], offset: int = 61) -> DataFrame:
    """id, score, rank by the sum of 1/(offset + rank) over the lists; ties in order of first appearance."""
    out = None
    for n, x in enumerate(lists):
        one = x.select("id", "rank", F.lit(n).alias("list"))
        out = one if out is None else out.unionByName(one)
    s = out.groupBy("id").agg(F.sum(1.0 / (offset + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "first", "id")).cast("long") - 1).drop("first")


def hybrid(docs: DataFrame, query: DataFrame, words: list[str], mode: str = "hybrid", pool: int = POOL, top: int = TOP, rerank: Callable | None = None, text: str = "") -> DataFrame:
    """id, score, rank, match (both, semantic, bm25, reranked), semantic and keyword scores.

    The scores come from the full lists, not the pools. rerank(query, texts) scores the `pool` first candidates anew."""
    ds, ks = dense(docs, query), bm25(docs, words)
    d, s = best(ds, "score", pool), best(ks, "score", pool)
    if mode == "semantic":
        fused = d.withColumns({"rd": F.col("rank"), "rs": F.lit(None).cast("int")})
    elif mode == "keyword":
        fused = s.withColumns({"rs": F.col("rank"), "rd": F.lit(None).cast("int")})
    elif mode == "hybrid":
        fused = fuse_common_first(d, s)
    else:
        raise ValueError(f"unknown mode {mode}")
    match = F.when(F.col("rd").isNotNull() & F.col("rs").isNotNull(), "both").when(F.col("rd").isNotNull(), "semantic").otherwise("bm25")
    kept = fused.where(F.col("rank") < pool).select("id", "score", "rank", match.alias("match"))
    if rerank is not None:
        few = kept.join(docs.select("id", "text"), "id")
        score = F.pandas_udf(lambda t: pd.Series(rerank(text, t.tolist()), dtype=float), "double")
        few = few.withColumns({"score": score("text"), "match": F.lit("reranked")}).drop("rank", "text")
        kept = few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long") - 1)
    kept = kept.where(F.col("rank") < top)
    out = kept.join(ds.select("id", F.col("score").alias("semantic")), "id", "left").join(ks.select("id", F.col("score").alias("keyword")), "id", "left")
    return out


def lexical_rerank(query: str, texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that the text has."""
    from recollect.functions.text import query_words

    want = set(query_words(query))
    return [len(want & set(query_words(t or ""))) / max(1, len(want)) for t in texts]


def overlap_score(rank: Column, text: Column, query: str) -> Column:
    """The score without a re-ranker: by rank and by the share of the query's longer words in the text."""
    import re

    want = sorted({w for w in re.split("[^a-zA-Z0-9]+", query.lower()) if len(w) > 2})
    share = F.size(F.array_intersect(F.array(*[F.lit(w) for w in want]), ascii_words(text))) / len(want) if want else F.lit(0.0)
    return F.greatest(F.lit(0.10), F.least(F.lit(0.98), 0.55 / (1 + rank * 0.15) + 0.45 * share))


def overlap_fallback(docs: DataFrame, query: str, pool: int = POOL) -> DataFrame:
    """id, overlap, rank: rows that share words with the query, most first; the first rows by id if none does."""
    import re

    want = sorted({w for w in re.split("[^a-zA-Z0-9]+", query.lower()) if len(w) > 2})
    words = F.array(*[F.lit(w) for w in want]) if want else F.array().cast("array<string>")
    n = F.coalesce(F.size(F.array_intersect(words, ascii_words(F.col("text")))), F.lit(0)).cast("long")
    counted = docs.select("id", n.alias("overlap"))
    hits = best(counted.where("overlap > 0"), "overlap", pool)
    none = hits.agg(F.count("*").alias("hits"))
    rest = counted.orderBy("id").limit(pool).withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("long") - 1)
    return hits.unionByName(rest.crossJoin(F.broadcast(none)).where("hits = 0").drop("hits"))


def block_search(docs: DataFrame, queries: DataFrame, dim: int, k: int, query_rows: int = 2048, doc_rows: int = 20_000) -> DataFrame:
    """query, id, score, place: of every query (id, v) its k most alike docs (id, v), itself left out.

    Query blocks meet document parts as matrix products, each task sends k rows a query, and these are merged: nothing
    is broadcast, and neither side has to fit in memory."""
    n = queries.count()
    blocks, doc_parts = max(1, -(-n // query_rows)), max(4, -(-docs.count() // doc_rows))
    # both sides' keys of one type, or equal ones would be dealt to different tasks
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(doc_parts)).cast("int")
    q = queries.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(doc_parts - 1))).alias("p"), "id", doubles(F.col("v")).alias("v"))
    d = docs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), part.alias("p"), "id", doubles(F.col("v")).alias("v"))

    def join(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, y = (np.stack(z["v"].to_numpy()) for z in (a, b))
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        s = np.round(x @ y.T, 6)
        s[ia[:, None] == ib[None]] = -9.0
        least = max(0, s.shape[1] - k)
        kth = np.partition(s, least, axis=1)[:, least]
        i, j = np.nonzero((s >= kth[:, None]) & (s > -2.0))  # the k best and what ties with the last of them
        order = np.lexsort((ib[j], -s[i, j], i))
        i, j = i[order], j[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"query": ia[i][few], "id": ib[j][few], "score": s[i, j][few]})

    met = q.groupBy("b", "p").cogroup(d.groupBy("b", "p")).applyInPandas(join, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")
    return met.withColumn("place", place).where(F.col("place") <= k)


def context(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """One row, prompt: the hits' texts as numbered lines, or a sentence that there are none."""
    lines = hits.select("id", "rank").join(docs.select("id", "text"), "id").select("rank", F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.col("text")).alias("line"))
    all_ = lines.agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    text = F.concat_ws("\n", F.transform("x", lambda s: s["line"]))
    return all_.select(F.when(F.size("x") > 0, text).otherwise("No relevant memories found.").alias("prompt"))


__all__ = ["best", "block_search", "bm25", "context", "dense", "fuse_common_first", "fuse_sum", "hybrid", "lexical_rerank", "overlap_fallback", "overlap_score", "prefix_hits"]
