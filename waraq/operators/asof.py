"""As-of joins as one ordered scan over the union of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.operators.ordered import bucket_of, running


def asof(left: DataFrame, right: DataFrame, group: list[str], left_key: str, right_key: str, value: Column | str, out: str, forward: bool = False, bucket: int = 4096) -> DataFrame:
    """``left`` with ``out``: ``value`` of the right row of its group with the nearest key at or before (``forward``: at or after) its own.

    Keys are integers; rows of ``left`` with a null key get null.  Of right rows with equal keys the one with the greatest (``forward``: least) value is
    taken; right rows with a null key or null value are no candidates.  Only the distinct keys of both sides go through the scan, so
    ties of any number are one row there; its result is joined to the rows of ``left``, whose other columns move once.
    """
    value = F.col(value) if isinstance(value, str) else value
    a = left.select(*group, F.col(left_key).cast("bigint").alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_side", F.lit(1))
    b = right.select(*group, F.col(right_key).cast("bigint").alias("_key"), F.lit(0).alias("_side"), value.alias("_value")).where("_key IS NOT NULL AND _value IS NOT NULL")
    b = b.groupBy(*group, "_key", "_side").agg((F.min if forward else F.max)("_value").alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_at", -F.col("_key") if forward else F.col("_key"))
    scan = running(both, group, bucket_of(F.col("_at"), bucket), [F.col("_at"), F.col("_side")], lasts={"_found": F.col("_value")}).where("_side = 1")
    found = scan.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_key").alias("_found_at"), "_found")
    same = F.col(left_key).cast("bigint") == F.col("_found_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return left.join(found, same, "left").select(*left.columns, F.col("_found").alias(out))
