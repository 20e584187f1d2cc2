"""References to records that do not exist.

Keys are cut into ranges. Within a range the keys of all sides are dictionary-encoded as integers, every (table,
period) and the parents become compressed bitmaps over those codes, and reference AND-NOT parent leaves the orphans,
which are decoded again. Each side is made distinct before the shuffle, so a key that a third of all rows refer to
costs one row per map task; a range holds a bounded number of keys, whatever the size of the tables. Rows find their
orphan keys again by a join that deals hot keys, of which the distinct step has the counts.

Defined cases: a null key is no reference; an id whose deliveries name several keys is an orphan if one of them is; order of arrival does not matter; repeated rows count once; empty parents
make every reference an orphan; empty references give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.bitmaps import Bitmap
from recollect.operators.hot import hot_keys, salted_join

KEYS_PER_RANGE = 100_000


def _range_orphans(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range: src (null for parents), ym, key, n -> the rows of src whose key no parent has."""
    key = pdf["key"].to_numpy()
    names, code = np.unique(key, return_inverse=True)  # the dictionary of this range
    parent = pdf["src"].isna().to_numpy()
    there = Bitmap(code[parent])
    out = []
    refs = pdf.loc[~parent, ["src", "ym", "n"]].assign(code=code[~parent])
    for (src, ym), part in refs.groupby(["src", "ym"], dropna=False):
        left = Bitmap(part["code"].to_numpy()).and_not(there).values()
        if len(left):
            n = np.zeros(len(names), np.int64)
            n[part["code"]] = part["n"]
            out.append(pd.DataFrame({"src": src, "ym": None if pd.isna(ym) else ym, "key": names[left], "n": n[left]}))
    return pd.concat(out) if out else pd.DataFrame({"src": [], "ym": [], "key": key[:0], "n": []}, dtype=object)


def orphan_keys(refs: DataFrame, parents: DataFrame, rows: int, keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """src, ym, key, n of the references without parent: n rows of refs name that key.

    refs: src string, ym string, key; parents: key, of the same type (string or long). rows: a bound on the number of
    different keys of both sides, such as their row counts, which file footers tell; it sets the number of ranges."""
    kind = dict(parents.dtypes)["key"]
    n = max(1, -(-rows // keys_per_range))
    # whole numbers go by spans of neighbouring values, so their codes lie close; names by hash
    cut = F.pmod(F.xxhash64(F.shiftright("key", 16) if kind == "bigint" else F.col("key")), F.lit(n))
    a = refs.where(F.col("key").isNotNull()).groupBy("src", "ym", "key").agg(F.count("*").alias("n"))
    b = parents.where(F.col("key").isNotNull()).select("key").distinct()
    none = F.lit(None).cast("string")
    both = a.unionByName(b.select(none.alias("src"), none.alias("ym"), "key", F.lit(0).cast("long").alias("n")))
    return both.withColumn("part", cut).groupBy("part").applyInPandas(_range_orphans, f"src string, ym string, key {kind}, n long")


def references(df: DataFrame, src: str, row_id: str, key) -> DataFrame:
    """src, row_id, ym, key: a row per id and different key that its deliveries name, dated by the id's first arrival."""
    one = df.groupBy(F.col(row_id).alias("row_id"), key.alias("key")).agg(F.min("loaded_at").alias("at"))
    first = F.min("at").over(Window.partitionBy("row_id"))
    dated = one.withColumn("at", first).where(F.col("key").isNotNull())
    return dated.select(F.lit(src).alias("src"), "row_id", F.date_format("at", "yyyy-MM").alias("ym"), "key")


def existing(rows: DataFrame, key: str, arrived: str, removals: DataFrame, removed: str) -> DataFrame:
    """key: those with a row that arrived after their last removal, or without removal."""
    last = removals.groupBy(F.col(key).alias("key")).agg(F.max(removed).alias("gone"))
    seen = rows.groupBy(F.col(key).alias("key")).agg(F.max(arrived).alias("seen"))
    return seen.join(last, "key", "left").where(F.col("gone").isNull() | (F.col("seen") > F.col("gone"))).select("key")


def orphan_rows(refs: DataFrame, orphans: DataFrame, rows: int) -> DataFrame:
    """src, row_id, ym of the rows of refs whose (src, ym, key) is an orphan. rows: those of refs, or a bound on them.

    A lost key that many rows name is dealt to several tasks."""
    keys = ["src", "m", "key"]
    lost = orphans.select("src", F.coalesce("ym", F.lit("")).alias("m"), "key", "n")
    mine = refs.withColumn("m", F.coalesce("ym", F.lit("")))
    found = salted_join(mine, lost.drop("n"), keys, hot_keys(lost, keys, rows), ["row_id"], "left_semi")
    return found.select("src", "row_id", "ym").distinct()
