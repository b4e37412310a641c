"""Running values over long ordered groups.

A group (a book, say) may hold a third of all rows, so no group is one window partition.  Its rows are cut into
buckets that follow the order; bucket totals are scanned first, over one row per bucket, and then each bucket on its own,
starting from what the buckets before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waraq.shared import written

#: Units of the order column in one bucket.
BUCKET = 4096


def bucket_of(order: Column, size: int = BUCKET) -> Column:
    """Bucket of an integer order column; null orders before all."""
    return F.coalesce(F.floor(order / size), F.lit(-(2**40))).cast("bigint")


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, least: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
            stored: bool = False) -> DataFrame:
    """``df`` with running columns in the order (bucket, order) within ``group``, each row included.

    ``sums``: running sums, nulls as 0.  ``lasts``: last value that isn't null.  ``least``: running minimum.
    ``previous``: last value that isn't null of the rows strictly before.
    ``stored``: ``df`` reads a stored table through nothing but filters and projections, so it is read twice instead of written again.
    ``bucket`` must not fall along ``order``; ties in ``order`` are the caller's to break.
    """
    sums, lasts, least, previous = sums or {}, lasts or {}, least or {}, previous or {}
    either = {**lasts, **previous}
    key = F.struct(*[F.col(g) for g in group], bucket.alias("_bucket"))  # equal where its parts are, nulls included, so windows and join share one partitioning
    rows = df.select("*", key.alias("_k"), *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()],
                     *[c.alias(f"_v_{n}") for n, c in [*either.items(), *least.items()]])
    rows = rows if stored else written(rows, "ordered-rows")  # read twice below; unwritten, a chain of scans would double its plan at every step
    rank = F.struct(*order)
    totals = rows.groupBy("_k").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_t_{n}") for n in either],
        *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in least])
    before = Window.partitionBy(*[f"_k.{g}" for g in group]).orderBy("_k._bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_k").alias("_rk"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
                            *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in either],
                            *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in least])
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(*df.columns, "_k", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums],
                        *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in lasts],
                        *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in previous],
                        *[F.min(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in least])
    joined = local.join(carried, F.col("_k") == F.col("_rk"))
    return joined.select(*df.columns, *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
                         *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in either],
                         *[F.least(f"_l_{n}", f"_c_{n}").alias(n) for n in least])
