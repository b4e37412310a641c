"""Queue, status and page lists of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waraq.functions.text import safe_name
from waraq.operators.ordered import bucket_of, running
from waraq.operators.outline import PAGES
from waraq.operators.volumes import first_wins
from waraq.shared import written

#: Missing pages between two outline entries up to which they are filled in without evidence.
LINEAR_GAP = 20
#: Pages assumed past the last outline entry where the last page isn't known.
ASSUMED_TAIL = 100


def queue(sources: list[DataFrame], done: DataFrame | None = None, single: int | None = None) -> DataFrame:
    """(book_id, source, category_label) of the books to process: earlier sources first, each book once, books in ``done`` left out.

    Each source has book_id and may have category_label and pos, its order.  ``single`` counts only where there are no sources.
    """
    rows = None
    for k, s in enumerate(sources):
        own = s.where("book_id IS NOT NULL").select("book_id", F.lit(k).alias("source"), *[F.col(c) if c in s.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("category_label", "string"), ("pos", "bigint"))])
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("name at least one source") if single is None else ValueError("a single book needs no queue")
    kept = first_wins(rows, ["book_id"], ["source", F.coalesce("pos", F.lit(0)), F.coalesce("category_label", F.lit(""))])
    if done is not None:
        kept = kept.join(done.select("book_id"), "book_id", "left_anti")
    return kept.select("book_id", "source", "category_label")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """(status, n) with "?" for none."""
    return df.groupBy(F.coalesce(F.col(status), F.lit("?")).alias("status")).agg(F.count("*").alias("n"))


def tally(df: DataFrame, status: str, good: list[str]) -> DataFrame:
    """(n_done, n_open): one row."""
    ok = F.col(status).isin(good)
    return df.agg(F.count_if(ok).alias("n_done"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_open"))


def with_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer lookup of one row per key; a missing one leaves nulls."""
    return rows.join(first_wins(lookup, keys, [c for c in lookup.columns if c not in keys]), keys, "left")


def first_n(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark applies the limit before the shuffle, too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def directory(category: Column, author: Column, title: Column) -> Column:
    """Path of a book below the output folder."""
    return F.concat_ws("/", safe_name(category), safe_name(author), safe_name(title))


def first_page(books: DataFrame, toc: DataFrame, volumes: DataFrame) -> DataFrame:
    """(book_id, first_page): 1, or less where a volume or outline entry begins earlier."""
    v = volumes.groupBy("book_id").agg(F.min("start_page").alias("v"))
    t = toc.where("page_id <> 0").groupBy("book_id").agg(F.min("page_id").alias("t"))
    return books.select("book_id").distinct().join(v, "book_id", "left").join(t, "book_id", "left").select("book_id", F.least(F.lit(1), "v", "t").alias("first_page"))


def page_ids(toc: DataFrame, known: DataFrame, start: int = 1) -> DataFrame:
    """(book_id, page_id, origin) of the pages a book should have, from ``start`` on.

    Origins: ``anchor`` (an outline entry), ``before`` the first one, ``gap`` between two with at most ``LINEAR_GAP`` missing, ``walked`` (a known
    page in a longer gap), ``tail`` after the last up to the last known page (``ASSUMED_TAIL`` where no page is known).  Books with fewer than
    two anchors have their known pages.  ``known``: (book_id, page_id) of pages linked to each other.
    """
    anchors = toc.where("page_id <> 0 AND book_id IS NOT NULL").select("book_id", "page_id").distinct()
    span = anchors.groupBy("book_id").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count("*").alias("n"))
    last = known.groupBy("book_id").agg(F.max("page_id").alias("last"))
    nexts = running(anchors.withColumn("_at", -F.col("page_id")), ["book_id"], bucket_of(F.col("_at"), PAGES), [F.col("_at")], previous={"next": F.col("page_id")})
    nexts = nexts.join(span.where("n >= 2").select("book_id"), "book_id", "left_semi").select("book_id", "page_id", "next")
    nexts = written(nexts, "anchors")
    own = nexts.where(F.col("page_id") >= start).select("book_id", "page_id", F.lit("anchor").alias("origin"))
    missing = F.col("next") - F.col("page_id") - 1
    gaps = nexts.where((missing > 0) & (missing <= LINEAR_GAP)).select("book_id", F.explode(F.sequence(F.col("page_id") + 1, F.col("next") - 1)).alias("page_id"), F.lit("gap").alias("origin")).where(F.col("page_id") >= start)
    spans = span.where("n >= 2").join(last, "book_id", "left")
    before = spans.where(F.col("lo") > start).select("book_id", F.explode(F.sequence(F.lit(start), F.col("lo") - 1)).alias("page_id"), F.lit("before").alias("origin"))
    until = F.coalesce("last", F.col("hi") + ASSUMED_TAIL)
    tail = spans.where(until > F.col("hi")).select("book_id", F.explode(F.sequence(F.greatest(F.col("hi") + 1, F.lit(start)), F.greatest(until, F.col("hi") + 1, F.lit(start)))).alias("page_id"), F.lit("tail").alias("origin"))
    from waraq.operators.asof import asof

    wide = nexts.where(missing > LINEAR_GAP).select("book_id", F.col("page_id").alias("_from"), F.struct(F.col("page_id").alias("lo"), "next").alias("_gap"))
    found = asof(known.select("book_id", "page_id").distinct(), wide, ["book_id"], "page_id", "_from", "_gap", "gap", bucket=PAGES)
    walked = found.where((F.col("page_id") > F.col("gap.lo")) & (F.col("page_id") < F.col("gap.next")) & (F.col("page_id") >= start)).select("book_id", "page_id", F.lit("walked").alias("origin"))
    rest = known.select("book_id", "page_id").distinct().join(span.where("n >= 2").select("book_id"), "book_id", "left_anti").where(F.col("page_id") >= start).select("book_id", "page_id", F.lit("walked").alias("origin"))
    return own.union(gaps).union(before).union(tail).union(walked).union(rest)


def next_pages(pages: DataFrame) -> DataFrame:
    """(book_id, page_id, next_id): the following page of the book, null at the last."""
    rows = pages.select("book_id", "page_id").where("page_id IS NOT NULL").distinct().withColumn("_at", -F.col("page_id"))
    return running(rows, ["book_id"], bucket_of(F.col("_at"), PAGES), [F.col("_at")], previous={"next_id": F.col("page_id")}).select("book_id", "page_id", "next_id")


def chain(edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(book_id, page_id, step): the pages met when following next_id from each book's start, step counting from 0.

    Doubling: the list of a start doubles with each round, so a chain of n pages takes log2(n) joins on (book_id, page_id), not n.
    Pages that lead to themselves or back end the walk where it would repeat.  ``stops``: (book_id, stop_id) of pages that end the walk and are not part of it.
    """
    if stops is not None:
        ends = stops.where("stop_id IS NOT NULL").select("book_id", "stop_id").distinct()
        edges = edges.join(ends.withColumnRenamed("stop_id", "next_id"), ["book_id", "next_id"], "left_anti")
        starts = starts.join(ends.withColumnRenamed("stop_id", "page_id"), ["book_id", "page_id"], "left_anti")
    jump = edges.where("next_id IS NOT NULL").select("book_id", "page_id", F.col("next_id").alias("to"))
    reached = written(starts.select("book_id", "page_id", F.lit(0).cast("bigint").alias("step")), "chain")
    size = 1
    while True:
        further = reached.join(jump, ["book_id", "page_id"]).select("book_id", F.col("to").alias("page_id"), (F.col("step") + size).alias("step"))
        both = reached.unionByName(further).groupBy("book_id", "page_id").agg(F.min("step").alias("step"))
        both = written(both, "chain")
        if both.count() == reached.count():
            return both
        reached = both
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.to") == F.col("b.page_id"))).select("a.book_id", "a.page_id", F.col("b.to").alias("to")), "chain-jumps")
        size *= 2


def resume_points(expected: DataFrame, received: DataFrame, cursor: DataFrame | None = None) -> DataFrame:
    """(book_id, n_received, last_received, flushed_through, next_page_id) of every expected book.

    ``flushed_through``: last page of the gapless run of expected pages received.  What is on disk beats the cursor: the next page is the greater of the
    cursor's and the one after the last received.
    """
    got = received.select("book_id", "page_id").distinct().withColumn("got", F.lit(True))
    pages = expected.select("book_id", "page_id").distinct().join(got, ["book_id", "page_id"], "left")
    hole = pages.groupBy("book_id").agg(F.min(F.when(F.col("got").isNull(), F.col("page_id"))).alias("hole"), F.max("page_id").alias("last"))
    run = pages.join(hole, "book_id").groupBy("book_id").agg(F.max(F.when(F.col("hole").isNull() | (F.col("page_id") < F.col("hole")), F.col("page_id"))).alias("flushed_through"))
    disk = got.groupBy("book_id").agg(F.count("*").alias("n_received"), F.max("page_id").alias("last_received"))
    rows = run.join(disk, "book_id", "left")
    rows = rows.join(cursor.select("book_id", "next_page_id"), "book_id", "left") if cursor is not None else rows.withColumn("next_page_id", F.lit(None).cast("int"))
    return rows.select("book_id", F.coalesce("n_received", F.lit(0)).alias("n_received"), "last_received", "flushed_through",
                       F.coalesce(F.greatest("next_page_id", F.col("last_received") + 1), F.lit(1)).alias("next_page_id"))


def ingest_status(expected: DataFrame, received: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(book_id, status, next_page_id, last_page_id, pages_scraped, error) of every expected book.

    ``runs``: (book_id, ended_at, outcome, error) of runs so far, the last of a book counts; outcomes are ``error``, ``interrupted`` and others.  A book is done when nothing
    expected lies at or after its next page and it has any page; else error or paused after such a run; else in_progress.
    """
    points = resume_points(expected, received)
    last = expected.groupBy("book_id").agg(F.max("page_id").alias("last_page_id"))
    rows = points.join(last, "book_id")
    if runs is not None:
        latest = runs.groupBy("book_id").agg(F.max_by(F.struct("outcome", "error"), F.struct("ended_at", "outcome", "error")).alias("run")).select("book_id", "run.*")
        rows = rows.join(latest, "book_id", "left")
    else:
        rows = rows.withColumns({"outcome": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    done = (F.col("n_received") > 0) & (F.col("next_page_id") > F.col("last_page_id"))
    status = F.when(done, "done").when(F.col("outcome") == "error", "error").when(F.col("outcome") == "interrupted", "paused").otherwise("in_progress")
    return rows.select("book_id", status.alias("status"), "next_page_id", "last_page_id", F.col("n_received").alias("pages_scraped"), F.when(status == "error", F.col("error")).alias("error"))
