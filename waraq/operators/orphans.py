"""References to records that do not exist (problem 1).

References and parent keys are brought to the same partitions and sorted by (book, number); one
sort-merge join then walks both streams.  Before it, the deliveries of a page are folded to its
validity interval: when it first arrived and whether it was ever taken down.  The state of a
reference follows from that interval alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.operators.skew import left_lookup


def references(df: DataFrame, name: str, ref_id: str, number: str, recorded_at: str = "recorded_at", book: str = "book_id") -> DataFrame:
    """Rows of ``df`` that refer to a page: a number that is null or 0 is no reference."""
    return df.where(F.col(number).isNotNull() & (F.col(number) != 0)).select(
        F.lit(name).alias("ref_table"), F.col(ref_id).cast("bigint").alias("ref_id"), F.col(book).alias("book_id"),
        F.col(number).alias("number"), F.col(recorded_at).alias("recorded_at"))


def validity(pages: DataFrame) -> DataFrame:
    """One row per (book_id, number): first arrival, whether any delivery was removed; partial aggregation folds hot pages map-side."""
    return (
        pages.select("book_id", F.coalesce("page_id", "url_page_id").alias("number"), "received_at", "removed_at")
        .where(F.col("number").isNotNull() & F.col("book_id").isNotNull())
        .groupBy("book_id", "number")
        .agg(F.min("received_at").alias("first_received"), F.max(F.col("removed_at").isNotNull()).alias("removed"))
    )


def orphan_references(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References whose page is missing, deleted or late: (ref_table, ref_id, book_id, number, recorded_at, state).

    ``refs`` is the union of ``references(...)``.  A reference with null book_id meets no page and is missing.
    Null recorded_at or a page with no received_at can't be late.  Equal rows each keep a row of their own; an
    empty ``pages`` makes every reference missing; empty ``refs`` give no row.  Other columns of the inputs are ignored.
    """
    seen = validity(pages).withColumn("found", F.lit(True))
    joined = left_lookup(refs.select("ref_table", "ref_id", "book_id", "number", "recorded_at"), seen, ["book_id", "number"], F.struct("ref_table", "ref_id"))
    state = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("removed"), "deleted")
        .when(F.col("first_received") > F.col("recorded_at"), "late")
    )
    return joined.withColumn("state", state).where(F.col("state").isNotNull()).select("ref_table", "ref_id", "book_id", "number", "recorded_at", "state")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of recorded_at (YYYY-MM, null where unknown) and state."""
    return orphans.groupBy("ref_table", F.date_format("recorded_at", "yyyy-MM").alias("month"), "state").agg(F.count("*").alias("n_refs"))
