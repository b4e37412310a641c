"""Renumbering the headings of books whose outline disagrees with their text.

Which books those are is found with scans over all headings; an automatic heading meets its nearest equal implicit one by
a join.  The headings of the flagged books are then numbered in *level order*, by level and within a level by place:

* a root keeps its number if that is above the number of the root before, else it gets the next one: its rank plus the greatest (own number less rank) so far,
* a heading below a known parent is the parent's number and its rank among the parent's children,
* a deeper heading without one (automatic headings above all) gets one more than the first part of the number of the heading before it.

All three are scans and joins over narrow columns; a book of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waraq.functions.text import normalize
from waraq.operators.asof import asof
from waraq.operators.ordered import bucket_of, running
from waraq.operators.outline import PAGES
from waraq.shared import written

KEY = ["book_id", "from_page", "from_sub", "ord"]
PLACE = ["page_id", "sub_idx", "pi", "li", "after", "ord"]


def with_page_order(headings: DataFrame) -> DataFrame:
    """Headings with their place: page (page_id, sub_idx) and first position."""
    return headings.where("ord IS NOT NULL").withColumn("pi", F.col("positions")[0]["pi"]).withColumn("li", F.col("positions")[0]["li"])


def needs_renumbering(headings: DataFrame) -> DataFrame:
    """(book_id) of books where, in the written table ``headings``, a heading stands before its bracketed parent, or neighbouring numbers fall."""
    rows = with_page_order(headings)
    place = F.struct("page_id", "sub_idx", "pi", "li")
    parents = rows.where("bracket_matched AND NOT implicit AND uid IS NOT NULL").select("book_id", F.col("uid").alias("parent_uid"), place.alias("parent_place"))
    before = rows.where("parent_uid IS NOT NULL").select("book_id", "parent_uid", place.alias("place")).join(parents, ["book_id", "parent_uid"]).where("place < parent_place").select("book_id")
    parts = F.transform(F.split("number", "[.]"), lambda x: x.cast("int"))
    own = rows.where("NOT auto").select("book_id", "page_id", "sub_idx", "ord", parts.alias("n"))
    scan = running(own, ["book_id"], bucket_of(F.col("page_id"), PAGES), [F.col("page_id"), F.col("sub_idx"), F.col("ord")], previous={"last": F.col("n")}, stored=True)
    return before.union(scan.where("n < last").select("book_id")).distinct()


def nearest_implicit(headings: DataFrame) -> DataFrame:
    """Automatic headings with the implicit heading of the same canonical text on another page that is nearest, the earlier on a tie.

    (book_id, page_id, sub_idx, ord) of the automatic heading, (implicit_page, implicit_sub, implicit_ord) of the other.  Distances are those of page numbers.
    Equal texts meet in one sorted scan each way, not pair by pair.
    """
    rows = with_page_order(headings).withColumn("norm", normalize("text"))
    return nearest(rows.where("auto AND NOT implicit").select("book_id", "norm", "page_id", "sub_idx", "ord"), rows.where("implicit AND NOT auto").select("book_id", "norm", "page_id", "sub_idx", "ord"))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each row of ``left`` the row of ``right`` in its (book_id, norm) with the nearest other page_id."""
    group = ["book_id", "norm"]
    folded = right.groupBy(*group, F.col("page_id").alias("_page")).agg(F.min(F.struct("page_id", "sub_idx", "ord")).alias("one"))
    rows = left.select(*group, "page_id", "sub_idx", "ord", (F.col("page_id") - 1).alias("_below"), (F.col("page_id") + 1).alias("_above"))
    seen = asof(rows, folded, group, "_below", "_page", "one", "_a", bucket=PAGES)
    seen = asof(seen, folded, group, "_above", "_page", "one", "_b", forward=True, bucket=PAGES)
    pick = F.when(F.col("_b").isNull() | (F.col("page_id") - F.col("_a.page_id") <= F.col("_b.page_id") - F.col("page_id")), F.col("_a")).otherwise(F.col("_b"))
    return seen.withColumn("_p", F.coalesce(pick, "_b", "_a")).where("_p IS NOT NULL").select(
        "book_id", "page_id", "sub_idx", "ord", F.col("_p.page_id").alias("implicit_page"), F.col("_p.sub_idx").alias("implicit_sub"), F.col("_p.ord").alias("implicit_ord"))


def promoted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rises`` and the level and parent of the one heading a book that rises beside its parent.

    It is the first, in document order, that stands before its bracketed parent on one page and below its level; automatic and implicit headings never become roots.
    """
    place = F.struct("page_id", "sub_idx", "pi", "li")
    above = rows.where("uid IS NOT NULL AND bracket_matched AND NOT implicit").select("book_id", F.col("uid").alias("parent_uid"), F.col("level").alias("_level"), F.col("parent_uid").alias("_parent"), place.alias("_place"))
    met = rows.where("level <> 0").join(above, ["book_id", "parent_uid"]).where((F.col("_place.page_id") == F.col("page_id")) & (F.col("_place.sub_idx") == F.col("sub_idx")) & (place < F.col("_place")))
    met = met.where("_level < level AND NOT (_level = 0 AND (auto OR implicit))")
    first = met.groupBy("book_id").agg(F.min_by(F.struct(*KEY[1:], F.col("_level").alias("to_level"), F.col("_parent").alias("to_parent")), F.struct(*PLACE)).alias("_one"))
    first = first.select("book_id", "_one.*", F.lit(True).alias("rises"))
    joined = rows.join(first, KEY, "left").withColumn("rises", F.coalesce("rises", F.lit(False)))
    return joined.withColumn("level", F.when(F.col("rises"), F.col("to_level")).otherwise(F.col("level"))).withColumn("parent_uid", F.when(F.col("rises"), F.col("to_parent")).otherwise(F.col("parent_uid"))).drop("to_level", "to_parent")


def in_level_order() -> tuple[Column, list[Column]]:
    """Bucket and order of the headings of a book by level, then by place."""
    return F.shiftleft(F.col("level").cast("bigint"), 40) + F.floor(F.col("page_id") / PAGES), [F.col("level"), *[F.col(c) for c in PLACE]]


def numbered_anew(rows: DataFrame) -> DataFrame:
    """``KEY`` with level, parent_uid and the new number of headings that come with KEY, PLACE, level, number, uid, parent_uid, auto, implicit, bracket_matched."""
    rows = promoted(rows)
    known = rows.where("uid IS NOT NULL").select("book_id", F.col("uid").alias("parent_uid"), F.lit(True).alias("_known")).distinct()
    kind = F.when(F.col("level") == 0, "root").when(F.col("_known"), "child").otherwise("alone")
    rows = written(rows.join(known, ["book_id", "parent_uid"], "left").withColumn("kind", kind).select(*KEY[:3], *PLACE, "level", "number", "uid", "parent_uid", "rises", "kind"), "level-order")  # read by the scan and for the depth
    bucket, order = in_level_order()
    deepest = rows.agg(F.max("level").alias("d")).first()["d"] or 0

    is_root, alone = F.col("kind") == "root", F.col("kind") == "alone"
    ranked = running(rows, ["book_id"], bucket, order, sums={"rank": is_root.cast("int"), "n": alone.cast("int")}, stored=True)
    own = F.when(is_root & ~F.col("rises"), F.split("number", "[.]")[0].cast("bigint"))
    rows = running(ranked, ["book_id"], bucket, order, least={"lag": F.col("rank") - own})
    rows = rows.withColumn("top", F.when(is_root, F.col("rank") - F.least(F.lit(0), F.coalesce("lag", F.lit(0)))))
    rows = written(rows.select(*KEY[:3], *PLACE, "level", "uid", "parent_uid", "kind", "n", "top"), "level-tops")  # read four times below

    children = running(rows.where("kind = 'child'").select(*KEY[:3], *PLACE, "level", "uid", "parent_uid"), ["book_id", "parent_uid"], bucket, order, sums={"k": F.lit(1)}, stored=True)
    children = written(children.select(*KEY, "uid", "parent_uid", "k"), "child-ranks")
    up = children.where("uid IS NOT NULL").select("book_id", F.col("uid").alias("_uid"), F.col("parent_uid").alias("_up"), F.col("k").alias("_k"))
    paths = children.select(*KEY, F.col("parent_uid").alias("head"), F.array("k").alias("path"))
    for _ in range(deepest - 1):  # each hop one level up
        hop = paths.alias("p").join(up.alias("u"), (F.col("p.book_id") == F.col("u.book_id")) & (F.col("head") == F.col("_uid")), "left")
        paths = hop.select(*[F.col(f"p.{c}") for c in KEY], F.coalesce("_up", "head").alias("head"), F.when(F.col("_k").isNotNull(), F.concat(F.array("_k"), "path")).otherwise(F.col("path")).alias("path"))
    of_root = rows.where("kind = 'root' AND uid IS NOT NULL").select("book_id", F.col("uid").alias("head"), F.col("top").alias("_top"))
    tops = rows.join(paths, KEY, "left").join(of_root, ["book_id", "head"], "left").withColumn("top", F.coalesce("top", "_top")).drop("_top")
    tops = _alone(written(tops, "level-tops"), bucket, order)
    number = F.array_join(F.concat(F.array("top"), F.coalesce("path", F.array().cast("array<bigint>"))).cast("array<string>"), ".")
    return tops.select(*KEY, "level", "parent_uid", number.alias("number"))


def _alone(tops: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """``top`` of headings without a parent, and of those below them: one more than that of the heading before.

    One scan suffices unless such headings have children; then one more for each level that has such children.
    """
    levels = sorted(r["level"] for r in tops.where("top IS NULL AND kind = 'child'").select("level").distinct().collect())  # at most the depth of the outlines
    for level in [*levels, None]:
        scan = running(tops, ["book_id"], bucket, order, lasts={"_before": F.when(F.col("kind") != "alone", F.col("top") - F.col("n"))}, stored=level == (levels[0] if levels else None))
        tops = scan.withColumn("top", F.when(F.col("kind") == "alone", F.coalesce("_before", F.lit(0)) + F.col("n")).otherwise(F.col("top"))).drop("_before")
        if level is not None:
            tops = written(tops, "level-tops")
            of = tops.where("kind = 'alone' AND uid IS NOT NULL").select("book_id", F.col("uid").alias("head"), F.col("top").alias("_top"))
            tops = tops.join(of, ["book_id", "head"], "left").withColumn("top", F.when((F.col("kind") == "child") & F.col("top").isNull() & (F.col("level") == level), F.col("_top")).otherwise(F.col("top"))).drop("_top")
    return tops


def renumbered(headings: DataFrame) -> DataFrame:
    """The headings of every book that needs it, numbered anew, with the columns of ``headings``.

    An implicit heading moves to the page and line of its automatic one, which goes, and comes last among the headings of that page.
    """
    headings = written(headings, "headings")  # read several times below
    return _anew(headings, needs_renumbering(headings))


def in_document_order(headings: DataFrame) -> DataFrame:
    """All ``headings``, those of every book that needs it as ``renumbered``; rows of lines that only repeat a heading stay as they are."""
    headings = written(headings, "headings")
    flagged = written(needs_renumbering(headings), "renumbered-books")
    others = headings.join(flagged, "book_id", "left_anti")
    echoes = headings.where("ord IS NULL").join(flagged, "book_id", "left_semi")
    return others.unionByName(echoes).unionByName(_anew(headings, flagged))


def _anew(headings: DataFrame, books: DataFrame) -> DataFrame:
    """``renumbered`` for the given books; only narrow columns go through the scans."""
    rows = with_page_order(headings).join(books, "book_id", "left_semi")
    narrow = rows.select("book_id", "page_id", "sub_idx", "ord", "pi", "li", "level", "number", "uid", "parent_uid", "auto", "implicit", "bracket_matched")
    moves = written(nearest_implicit(headings.join(books, "book_id", "left_semi")), "heading-moves")  # read twice below
    target = narrow.select("book_id", "page_id", "sub_idx", "ord", "pi", "li").join(moves, ["book_id", "page_id", "sub_idx", "ord"])
    to = target.groupBy("book_id", F.col("implicit_page"), F.col("implicit_sub"), F.col("implicit_ord")).agg(F.max(F.struct("page_id", "sub_idx", "pi", "li", "ord")).alias("to"))
    kept = narrow.join(moves, ["book_id", "page_id", "sub_idx", "ord"], "left_anti")
    moved = kept.alias("k").join(to.alias("t"), (F.col("k.book_id") == F.col("t.book_id")) & (F.col("k.page_id") == F.col("t.implicit_page")) & (F.col("k.sub_idx") == F.col("t.implicit_sub")) & (F.col("k.ord") == F.col("t.implicit_ord")), "left")
    final = moved.select("k.book_id", F.col("k.page_id").alias("from_page"), F.col("k.sub_idx").alias("from_sub"), "k.ord", F.col("t.to.ord").alias("after"),
                         *[F.coalesce(f"t.to.{c}", f"k.{c}").alias(c) for c in ("page_id", "sub_idx", "pi", "li")],
                         *[f"k.{c}" for c in ("level", "number", "uid", "parent_uid", "auto", "implicit", "bracket_matched")])
    final = written(final, "headings-in-place")
    page = Window.partitionBy("book_id", "page_id", "sub_idx")  # the headings of one page
    last = F.coalesce(F.max(F.when(F.col("after").isNull(), F.col("ord"))).over(page), F.lit(-1))
    rank = F.row_number().over(Window.partitionBy("book_id", "page_id", "sub_idx", F.col("after").isNull()).orderBy("after", *KEY[1:]))
    placed = final.select(*KEY, "page_id", "sub_idx", "pi", "li", F.when(F.col("after").isNull(), F.col("ord")).otherwise(last + rank).cast("int").alias("new_ord"))
    anew = placed.join(numbered_anew(final), KEY)
    both = rows.alias("h").join(anew.alias("n"), (F.col("h.book_id") == F.col("n.book_id")) & (F.col("h.page_id") == F.col("n.from_page")) & (F.col("h.sub_idx") == F.col("n.from_sub")) & (F.col("h.ord") == F.col("n.ord")))
    gone = (F.col("n.page_id") != F.col("n.from_page")) | (F.col("n.sub_idx") != F.col("n.from_sub"))
    here = F.array(F.struct(F.col("n.pi").alias("pi"), F.col("n.li").alias("li")))
    new = {c: F.col(f"n.{c}") for c in ("page_id", "sub_idx", "level", "number", "parent_uid")} | {
        "ord": F.col("n.new_ord"), "positions": F.when(gone, here).otherwise(F.col("h.positions")),
        "suppress": F.when(gone, F.array_union("h.suppress", here)).otherwise(F.col("h.suppress")), "at_page_top": F.col("h.at_page_top") & ~gone}
    return both.select(*[new.get(c, F.col(f"h.{c}")).alias(c) for c in headings.columns])
