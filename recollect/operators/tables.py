"""Table operations: newest rows, insert, upsert, update, delete, cascade. A table is a DataFrame; each returns the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import checkpointed


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def append_with_ids(old: DataFrame, new: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """old and new, the new rows numbered on from the largest id, in the given order.

    Ranks within sorted partitions plus the counts of the partitions before: no task sees all rows. The sorted rows are
    checkpointed with the number of their partition, so ranks and counts are of the same partitions even if a task runs again."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    part = checkpointed(new.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = part.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = local.join(F.broadcast(before.select("_p", "_b")), "_p").crossJoin(F.broadcast(top))
    made = numbered.withColumn(key, F.col("_top") + F.col("_b") + F.col("_n")).drop("_top", "_b", "_n", "_p")
    return old.unionByName(made, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new replace those of the same key; of several the one with the largest `order` stays."""
    last = newest(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of changes take the place of old ones; rows that old lacks are not added."""
    cols = [c for c in changes.columns if c not in keys]
    c = changes.dropDuplicates(keys).select(*keys, *[F.col(x).alias(f"_new_{x}") for x in cols])
    j = old.join(c, keys, "left")
    return j.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in cols else F.col(x) for x in old.columns])


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, root: str, key: str, children: dict[str, tuple[str, str, str]]) -> dict[str, DataFrame]:
    """tables without the rows of `root` whose key is in gone, nor their descendants.

    children: child -> (parent, child's column, parent's key column); parents before their children."""
    lost = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    out = dict(tables) | {root: tables[root].join(gone.select(key).distinct(), key, "left_anti")}
    for child, (parent, column, parent_key) in children.items():
        keys = lost[parent].select(F.col(parent_key).alias(column)).distinct()
        lost[child] = tables[child].join(keys, column, "left_semi")
        out[child] = tables[child].join(keys, column, "left_anti")
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of every table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stamp(df: DataFrame, key: str = "id") -> DataFrame:
    """n, top: changes whenever rows were added or removed at the end."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.max(key), F.lit(0)).alias("top"))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of this key, or none; the comparison reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def newest_first(df: DataFrame, at: str, key: str = "id", limit: int | None = None) -> DataFrame:
    """All rows, or the first `limit`, by time downwards; rows without a time last, equal times by key."""
    out = df.orderBy(F.col(at).desc_nulls_last(), key)
    return out if limit is None else out.limit(limit)


def exists(df: DataFrame, name: str = "there") -> DataFrame:
    """One row, whether df has any."""
    return df.limit(1).agg((F.count("*") > 0).alias(name))


def delete_counted(old: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What delete() leaves, and one row n: how many rows went."""
    k = gone.select(*keys).distinct()
    return old.join(k, keys, "left_anti"), old.join(k, keys, "left_semi").agg(F.count("*").alias("n"))


def delete_all(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty table, and one row n: how many rows it had."""
    return old.limit(0), old.agg(F.count("*").alias("n"))
