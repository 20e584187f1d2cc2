"""Evaluation analytics: retrieval metrics, confusion counts, sweeps, latency, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """ranked: query, id, place (from 1); gold: query, id; queries: query -> query, hit1, hit3, hit5, mrr, p5, ndcg5, ap.

    Queries without gold or results score 0."""
    g = gold.select("query", "id").distinct()
    r = ranked.join(g.withColumn("rel", F.lit(1)), ["query", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = Window.partitionBy("query").orderBy("place")
    r = r.withColumn("seen", F.sum("rel").over(so_far))
    top = lambda n: F.max(F.when((F.col("place") <= n) & (F.col("rel") == 1), 1.0).otherwise(0.0))
    per = r.groupBy("query").agg(
        top(1).alias("hit1"), top(3).alias("hit3"), top(k).alias("hit5"),
        F.max(F.when(F.col("rel") == 1, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr"),
        (F.sum(F.when(F.col("place") <= k, F.col("rel"))) / F.lit(float(k))).alias("p5"),
        F.sum(F.when((F.col("place") <= k) & (F.col("rel") == 1), 1.0 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.avg(F.when(F.col("rel") == 1, F.col("seen") / F.col("place"))).alias("ap"),
    )
    size = g.groupBy("query").agg(F.count("*").alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = queries.join(per, "query", "left").join(size, "query", "left")
    out = out.withColumn("ndcg5", F.when(F.col("n_gold") > 0, F.col("dcg") / ideal))
    return out.drop("dcg", "n_gold").na.fill(0.0, ["hit1", "hit3", "hit5", "mrr", "p5", "ndcg5", "ap"])


def summary(per_query: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Means to 4 decimals and n, for each value of `by` and for all of them together ("all")."""
    kept = per_query.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    out = kept.rollup(by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c) for c in cols])
    return out.withColumn(by, F.coalesce(by, F.lit("all")))


def rates(found: Column, wrong: Column, missed: Column) -> dict[str, Column]:
    """precision, recall and f1 from counts; 0 where nothing was named or wanted."""
    p = F.when(found + wrong > 0, found / (found + wrong)).otherwise(0.0)
    r = F.when(found + missed > 0, found / (found + missed)).otherwise(0.0)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(2 * p * r / (p + r + 1e-9), 6)}


def confusion(pairs: DataFrame, named: str, truth: str) -> DataFrame:
    """thing, found, wrong, missed, and their rates, of every thing that is named or true."""
    things = pairs.select(F.explode(F.array_distinct(F.array(named, truth))).alias("thing"), named, truth).where("thing is not null")
    is_named, is_true = F.coalesce(F.col(named) == F.col("thing"), F.lit(False)), F.coalesce(F.col(truth) == F.col("thing"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    out = things.groupBy("thing").agg(n(is_named & is_true).alias("found"), n(is_named & ~is_true).alias("wrong"), n(~is_named & is_true).alias("missed"))
    return out.withColumns(rates(F.col("found"), F.col("wrong"), F.col("missed")))


def sweep(scored: DataFrame, cuts: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """cut, found, wrong, missed and rates of "score >= cut" for every cut, in one pass over the rows."""
    s, t = F.col(score), F.col(truth).cast("boolean")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    one = scored.agg(n(t).alias("wanted"), *[n((s >= c) & t).alias(f"f{i}") for i, c in enumerate(cuts)], *[n((s >= c) & ~t).alias(f"x{i}") for i, c in enumerate(cuts)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"f{i}").alias("found"), F.col(f"x{i}").alias("wrong"), (F.col("wanted") - F.col(f"f{i}")).alias("missed")) for i, c in enumerate(cuts)]))
    return one.select(rows.alias("r")).select("r.*").withColumns(rates(F.col("found"), F.col("wrong"), F.col("missed")))


def best_cut(swept: DataFrame) -> DataFrame:
    """The cut of the largest f1; of equal ones the larger cut."""
    return swept.groupBy().agg(F.max(F.struct("f1", "cut")).alias("b")).select("b.cut", "b.f1")


def threshold(scored: DataFrame, score: str, same: str) -> DataFrame:
    """t of .50 to .99 with the fewest wrong (same below t, different at or above it); the middle one of equal ones."""
    cuts = [round(0.5 + i / 100, 2) for i in range(50)]
    w = lambda c: F.sum(F.when(F.col(same), (F.col(score) < c).cast("long")).otherwise((F.col(score) >= c).cast("long")))
    one = scored.where(F.col(score).isNotNull() & F.col(same).isNotNull()).agg(*[w(c).alias(f"w{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.col(f"w{i}").alias("wrong"), F.lit(c).alias("t")) for i, c in enumerate(cuts)])
    low = F.array_min(F.transform("a", lambda x: x["wrong"]))
    ties = F.filter("a", lambda x: x["wrong"] == F.col("low"))
    return one.select(rows.alias("a")).withColumn("low", low).select(F.element_at(ties, F.floor(F.size(ties) / 2).cast("int") + 1)["t"].alias("t"), F.col("low").alias("wrong"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Upper median, nearest-rank 95th percentile and worst."""
    return df.groupBy(*by).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value} desc)").alias("upper_median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.max(value).alias("worst"), F.count(value).alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_hits(before: DataFrame, after: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """before, after: rank, id, score -> n, n_differ (other id, or one list longer), worst difference of scores, same."""
    j = before.select("rank", F.col("id").alias("a"), F.col("score").alias("sa")).join(after.select("rank", F.col("id").alias("b"), F.col("score").alias("sb")), "rank", "full_outer")
    off = ~F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("sa") - F.col("sb")) > tolerance)
    out = j.agg(F.count("*").alias("n"), F.sum(off.cast("long")).alias("n_differ"), F.round(F.max(F.abs(F.col("sa") - F.col("sb"))), 6).alias("worst"))
    return out.withColumn("same", F.col("n_differ") == 0)


def drift(df: DataFrame, order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the first and last n values and the change in percent."""
    first = df.orderBy(*order).limit(n).agg(F.avg(value).alias("first"))
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n).agg(F.avg(value).alias("last"))
    return first.crossJoin(last).withColumn("percent", F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 6)).withColumns({c: F.round(c, 6) for c in ("first", "last")})


def pareto(df: DataFrame, hits: str, costs: list[str]) -> DataFrame:
    """For each number of hits the row of least costs."""
    return df.groupBy(hits).agg(F.min(F.struct(*costs)).alias("b")).select(hits, *[F.col(f"b.{c}").alias(c) for c in costs])
