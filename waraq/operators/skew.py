"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Parts into which the rows of a hot key are split.
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: fewer than 1 / share rows, whatever the input's size."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.count()
    return counts.where(F.col("_n") > max(1.0, total * share)).select(*keys)


def left_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Left outer merge join of ``rows`` with ``lookup`` (one row a key).

    Rows of a hot key go to ``salts`` partitions by the hash of ``spread``, and the one lookup row
    of that key is repeated for each.  The list of hot keys is broadcast: it has under 1 / share rows.
    Keys that are null match nothing and keep their row.
    """
    hot = hot_keys(rows.select(*keys).na.drop(), keys, share).withColumn("_hot", F.lit(True))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    lookup = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0))))).drop("_hot")
    on = [*keys, "_salt"]
    a, b = rows.alias("a"), lookup.alias("b").hint("merge")
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]), "left")
    extra = [c for c in lookup.columns if c not in on]
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns if c != "_salt"], *[F.col(f"b.{c}") for c in extra])
