"""Outlines: repair of page numbers, hierarchical numbers, parents, and the pages that entries fall on.

An outline is a table (book_id, seq, level, label, page_id) in depth-first order.  Levels may go
as deep as the data; entries with a null or negative level keep their rows but get no number and count for nothing.  All scans run through ``running``, so one book may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import BLANK, DIGITS, STRIP
from waraq.operators.asof import asof
from waraq.operators.ordered import bucket_of, running

#: Pages in one bucket of a scan in page order.
PAGES = 512


def depth(toc: DataFrame) -> int:
    """Levels in use."""
    top = toc.agg(F.max("level").alias("top")).first()["top"]  # one row
    return max(0, top if top is not None else 0) + 1


def labelled() -> Column:
    """Whether an entry has a label; empty counts as none."""
    return F.coalesce(F.col("label") != "", F.lit(False))


def summary(toc: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, total_entries, top_level_entries, max_depth) of every book; zeros where it has no entry."""
    counts = toc.groupBy("book_id").agg(F.count("*").alias("total_entries"), F.count_if(F.col("level") == 0).alias("top_level_entries"), (F.max("level") + 1).alias("max_depth"))
    return books.select("book_id").distinct().join(counts, "book_id", "left").na.fill(0, ["total_entries", "top_level_entries", "max_depth"])


def repaired(toc: DataFrame) -> DataFrame:
    """``toc``, a stored table, with each labelled entry's page_id lowered to the least of itself and its labelled descendants.

    0 is no page.  Each labelled row is sent to its ancestors, at most one per level, and folded there by minimum.
    """
    rows = toc.withColumn("page_id", F.nullif(F.col("page_id"), F.lit(0)))
    n = depth(toc)
    at = {f"_a{d}": F.when(labelled() & (F.col("level") <= d), F.struct("seq", "level")) for d in range(n)}
    scanned = running(rows.select("book_id", "seq", "level", "label", "page_id"), ["book_id"], bucket_of(F.col("seq")), [F.col("seq")], lasts=at, stored=True)
    above = [F.when((F.col("level") > d) & (F.col(f"_a{d}.level") == d), F.col(f"_a{d}.seq")) for d in range(n)]
    sent = scanned.where(labelled() & F.col("page_id").isNotNull()).select("book_id", "page_id", F.explode(F.array_compact(F.array(F.col("seq"), *above))).alias("seq"))
    least = sent.groupBy("book_id", "seq").agg(F.min("page_id").alias("_least"))
    joined = rows.join(least, ["book_id", "seq"], "left")
    return joined.withColumn("page_id", F.when(labelled(), F.coalesce("_least", "page_id")).otherwise(F.col("page_id"))).select(*toc.columns)


def numbered(toc: DataFrame) -> DataFrame:
    """Entries with a page, in the order (page_id, seq), with number, parent_number, and the label and number then open.

    Every entry counts in its level and closes deeper ones; only labelled ones become parents.
    """
    n = depth(toc)
    known = toc.where(F.col("page_id").isNotNull() & (F.col("page_id") != 0) & F.col("book_id").isNotNull())
    countable = F.coalesce(F.col("level").between(0, n - 1), F.lit(False))
    rows = known.where(countable)
    order, bucket = [F.col("page_id"), F.col("seq")], bucket_of(F.col("page_id"), PAGES)
    counted = running(rows, ["book_id"], bucket, order, sums={f"_s{i}": (F.col("level") == i).cast("int") for i in range(n)})
    state = {f"_r{i}": F.when(F.col("level") < i, F.col(f"_s{i}")) for i in range(1, n)}
    state |= {f"_p{d}": F.when(F.col("level") <= d, F.struct("level", labelled().alias("named"), "label")) for d in range(n)}
    done = running(counted, ["book_id"], bucket, order, lasts=state)
    part = [F.col("_s0").cast("string")] + [(F.col(f"_s{i}") - F.coalesce(f"_r{i}", F.lit(0))).cast("string") for i in range(1, n)]
    number = lambda level: F.array_join(F.slice(F.array(*part), F.lit(1), level + 1), ".")
    is_open = [(F.col("level") > d) & (F.col(f"_p{d}.level") == d) & F.col(f"_p{d}.named") for d in range(n)]
    parent = F.coalesce(*[F.when(is_open[d], F.struct(number(F.lit(d)).alias("number"), F.col(f"_p{d}.label").alias("label"))) for d in range(n - 1, -1, -1)])
    numbers = done.withColumn("number", number(F.col("level"))).withColumn("_parent", parent).select(
        *toc.columns, "number", F.col("_parent.number").alias("parent_number"),
        F.when(labelled(), F.col("number")).otherwise(F.col("_parent.number")).alias("open_number"),
        F.when(labelled(), STRIP.column("label")).otherwise(STRIP.column("_parent.label")).alias("open_label"))
    return numbers.unionByName(known.where(~countable), allowMissingColumns=True)


def on_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``entries`` with ``page``: the first page of their book at or after their page_id; null past the last page."""
    return asof(entries, pages.select("book_id", F.col("page_id").alias("page")), ["book_id"], "page_id", "page", "page", "page", forward=True, bucket=PAGES)


def page_outline(toc: DataFrame, pages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(book_id, page_id, toc_number, toc_breadcrumb) of every page; ``entries`` is ``numbered(repaired(toc))`` where that is at hand.

    A page on which labelled entries begin shows their labels joined, and the range of their numbers; another page the deepest label still open, or empty strings.
    """
    pages = pages.select("book_id", "page_id").where("book_id IS NOT NULL AND page_id IS NOT NULL").distinct()
    entries = numbered(repaired(toc)) if entries is None else entries
    placed = on_pages(entries, pages).where("page IS NOT NULL")
    named = placed.where(labelled() & F.col("number").isNotNull()).withColumn("k", F.struct("page_id", "seq"))
    here = named.groupBy("book_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", STRIP.column("label").alias("label")))), lambda x: x["label"]), " • ").alias("labels"),
        F.min_by("number", "k").alias("first"), F.max_by("number", "k").alias("last"), F.count("*").alias("n"))
    state = entries.where("number IS NOT NULL").select("book_id", "page_id", F.struct("seq", "open_number", "open_label").alias("state"))
    shown = asof(pages, state.withColumnRenamed("page_id", "key"), ["book_id"], "page_id", "key", "state", "open", bucket=PAGES)
    joined = shown.join(here.withColumnRenamed("page", "page_id"), ["book_id", "page_id"], "left")
    number = F.when(F.col("n") > 1, F.concat_ws("-", "first", "last")).when(F.col("n") == 1, F.col("first")).otherwise(F.coalesce("open.open_number", F.lit("")))
    return joined.select("book_id", "page_id", number.alias("toc_number"), F.coalesce("labels", "open.open_label", F.lit("")).alias("toc_breadcrumb"))


def inversions(entries: DataFrame) -> DataFrame:
    """(book_id, n_inversions): neighbouring headings in page order whose numbers fall; books without any are left out."""
    entries = entries.where("number IS NOT NULL")
    parts = F.transform(F.split("number", "[.]"), lambda x: x.cast("int"))
    rows = running(entries.withColumn("_n", parts), ["book_id"], bucket_of(F.col("page_id"), PAGES), [F.col("page_id"), F.col("ord")], previous={"_before": F.col("_n")})
    return rows.where(F.col("_n") < F.col("_before")).groupBy("book_id").agg(F.count("*").alias("n_inversions"))


def bare(toc: DataFrame) -> DataFrame:
    """(book_id, n_entries, n_bare, is_bare): whether at least 80 % of a book's labels are only digits and blanks."""
    digits = F.coalesce(STRIP.column("label").rlike(rf"^[{DIGITS}{BLANK}]+$"), F.lit(False))
    counts = toc.groupBy("book_id").agg(F.count("*").alias("n_entries"), F.count_if(digits).alias("n_bare"))
    return counts.withColumn("is_bare", F.col("n_bare") >= 0.8 * F.col("n_entries"))


def with_parents(entries: DataFrame) -> DataFrame:
    """Numbered entries with the label of their parent and the number of their direct children."""
    parents = entries.where(labelled()).select("book_id", F.col("number").alias("parent_number"), F.col("label").alias("parent_label"))
    children = entries.where("parent_number IS NOT NULL").groupBy("book_id", F.col("parent_number").alias("number")).agg(F.count("*").alias("n_children"))
    rows = entries.join(parents, ["book_id", "parent_number"], "left").join(children, ["book_id", "number"], "left")
    return rows.select(*entries.columns, "parent_label", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def book_documents(books: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, document): each book's card and outline as one JSON text; the outline of one book is one array."""
    entries = toc.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "label", "page_id"))).alias("toc_flat"))
    return books.join(entries, "book_id", "left").select("book_id", F.to_json(F.struct(*books.columns, "toc_flat")).alias("document"))
