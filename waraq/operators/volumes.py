"""Volumes of a book: bounds, merging of introductions, the volume of a page, numbering inside volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.functions.text import STRIP
from waraq.operators.asof import asof
from waraq.operators.ordered import bucket_of, running
from waraq.operators.outline import PAGES, depth
from waraq.shared import written


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; folded map-side, so a key of any size is no burden."""
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def bounds(volumes: DataFrame) -> DataFrame:
    """(book_id, volume, start_page, last_page, label): volumes without repeats of a start, first wins; the last is open-ended (null)."""
    kept = first_wins(volumes.where("start_page IS NOT NULL").select("book_id", "start_page", "ord", "label"), ["book_id", "start_page"], ["ord"])
    w = Window.partitionBy("book_id").orderBy("start_page")  # the volumes of one book, a handful
    return kept.select("book_id", (F.row_number().over(w) - 1).alias("volume"), "start_page", (F.lead("start_page").over(w) - 1).alias("last_page"), "label")


def merged(bounds_: DataFrame) -> DataFrame:
    """``bounds`` with each introduction (label no number) joined to the numbered volume right after it: its start, that one's label."""
    w = Window.partitionBy("book_id").orderBy("volume")
    numeric = F.coalesce(STRIP.column("label").rlike("^[0-9\\x{0660}-\\x{0669}]+$"), F.lit(False))
    rows = bounds_.withColumn("_n", numeric).withColumn("_next", F.lead("_n").over(w)).withColumn("_before", F.lag("_n").over(w)).withColumn("_label", F.lead("label").over(w))
    joined = ~F.col("_n") & F.coalesce("_next", F.lit(False))
    kept = rows.where(~(F.col("_n") & F.coalesce(~F.col("_before"), F.lit(False)))).withColumn("label", F.when(joined, F.col("_label")).otherwise(F.col("label")))
    return kept.select("book_id", (F.row_number().over(w) - 1).alias("volume"), "start_page", (F.lead("start_page").over(w) - 1).alias("last_page"), "label")


def volume_of(rows: DataFrame, bounds_: DataFrame, page: str = "page_id") -> DataFrame:
    """``rows`` with ``volume``: the last one that starts at or before the page; -1 before the first, null without a page."""
    starts = bounds_.select("book_id", F.col("start_page").alias("_start"), "volume")
    found = asof(rows, starts.withColumnRenamed("volume", "_volume"), ["book_id"], page, "_start", "_volume", "volume", bucket=PAGES)
    return found.withColumn("volume", F.when(F.col(page).isNotNull(), F.coalesce("volume", F.lit(-1))))


def suffix(label, volume) -> object:
    """File suffix of a volume: blanks to underscores; a volume without label its number of two digits."""
    return F.coalesce(F.nullif(F.replace(STRIP.column(label), F.lit(" "), F.lit("_")), F.lit("")), F.lpad((volume + 1).cast("string"), 2, "0"))


def volume_numbers(headings: DataFrame, prefix: bool, levels: int | None = None) -> DataFrame:
    """``headings`` (book_id, volume, page_id, ord, level, auto, ...) with ``level_in_volume`` and ``volume_number``.

    Levels count from the least level met so far in the volume.  Missing ancestors count as 1.  An automatic heading shows the next
    number and consumes none.  With ``prefix`` the 1-based volume comes first and levels past the second have no number
    (empty).  Rows before the first volume (-1) or without one get nulls.
    """
    group, order, bucket = ["book_id", "volume"], [F.col("page_id"), F.col("ord")], bucket_of(F.col("page_id"), PAGES)
    rows = running(headings, group, bucket, order, least={"_base": F.col("level")}).withColumn("_level", F.greatest(F.col("level") - F.col("_base"), F.lit(0)).cast("int"))
    rows = rows.withColumn("_takes", ~F.col("auto") & ((F.col("_level") <= 1) if prefix else F.lit(True)))
    own = F.when(F.col("_takes"), F.col("_level"))
    rows = running(rows, group, bucket, order, previous={"_prev": own})
    levels = depth(headings) if levels is None else levels
    n = min(levels, 2 if prefix else levels)
    step = {f"_s{i}": F.when(F.col("_takes") & ((F.col("_level") == i) | ((F.col("_level") > i) & (F.coalesce("_prev", F.lit(-1)) < i))), 1) for i in range(n)}
    rows = running(rows, group, bucket, order, sums=step)
    if n > 1:
        rows = running(rows, group, bucket, order, lasts={f"_r{i}": F.when(own < i, F.col(f"_s{i}")) for i in range(1, n)})
    count = [F.col("_s0")] + [F.col(f"_s{i}") - F.coalesce(f"_r{i}", F.lit(0)) for i in range(1, n)]
    shown = F.array(*[F.when(F.col("auto"), F.when(F.col("_level") == i, c + 1).otherwise(F.greatest(c, F.lit(1)))).otherwise(c).cast("string") for i, c in enumerate(count)])
    number = F.array_join(F.slice(shown, F.lit(1), F.col("_level") + 1), ".")
    if prefix:
        number = F.when(F.col("_level") > 1, "").otherwise(F.concat_ws(".", (F.col("volume") + 1).cast("string"), number))
    inside = F.coalesce(F.col("volume") >= 0, F.lit(False))
    return rows.select(*headings.columns, F.when(inside, F.col("_level")).alias("level_in_volume"), F.when(inside, number).alias("volume_number"))


def skipped_in_outline(headings: DataFrame) -> DataFrame:
    """Implicit headings whose text an automatic heading earlier in their volume had; they get no bookmark of their own.

    ``headings``: (book_id, volume, page_id, ord, text, auto, implicit, ...).  Each text's first automatic heading is found by aggregation, so equal texts never pair up.
    """
    group = ["book_id", "volume", "text"]
    first = headings.where("auto AND text IS NOT NULL").groupBy(*group).agg(F.min(F.struct("page_id", "ord")).alias("_first"))
    own = headings.where("implicit AND NOT auto").join(first, group)
    return own.where(F.struct("page_id", "ord") > F.col("_first")).select(*headings.columns)


def several(bounds_: DataFrame) -> DataFrame:
    """``bounds_`` of the books with more than one volume; only these are numbered by volume."""
    return bounds_.join(bounds_.groupBy("book_id").count().where("count > 1"), "book_id", "left_semi")


def numbered_headings(headings: DataFrame, bounds_: DataFrame, prefix: bool = False) -> DataFrame:
    """Headings of pages with the numbers of their volume, and ``level_in_volume`` and ``skipped``: whether an implicit one gets no bookmark.

    Books without several volumes, pages before the first one, and rows without ``ord`` keep what they have, with a null level.
    Only narrow columns of the headings in volumes go through the scans.
    """
    key = ["book_id", "page_id", "sub_idx", "ord"]
    headings = written(headings, "headings-to-number")  # read three times below
    books = several(bounds_)
    rows = headings.where("ord IS NOT NULL").join(books.select("book_id").distinct(), "book_id", "left_semi")
    rows = rows.select("book_id", "page_id", F.struct("sub_idx", "ord").alias("ord"), "level", "text", "auto", "implicit")
    rows = written(volume_of(rows, books).where("volume >= 0"), "headings-in-volumes")
    numbers = volume_numbers(rows.drop("text", "implicit"), prefix, depth(rows))
    shown = rows
    if prefix:  # headings without a number take no part
        shown = rows.join(numbers.where("volume_number <> ''").select("book_id", "page_id", "ord"), ["book_id", "page_id", "ord"], "left_semi")
    skipped = skipped_in_outline(shown.select("book_id", "volume", "page_id", "ord", "text", "auto", "implicit")).select("book_id", "page_id", "ord", F.lit(True).alias("skipped"))
    found = numbers.select("book_id", "page_id", "ord", "level_in_volume", "volume_number").join(skipped, ["book_id", "page_id", "ord"], "left")
    found = found.select("book_id", "page_id", F.col("ord.sub_idx").alias("sub_idx"), F.col("ord.ord").alias("ord"), "level_in_volume", "volume_number", "skipped")
    joined = headings.join(found, key, "left")
    return joined.select(*[F.coalesce("volume_number", "number").alias(c) if c == "number" else F.col(c) for c in headings.columns], "level_in_volume", F.coalesce("skipped", F.lit(False)).alias("skipped"))
