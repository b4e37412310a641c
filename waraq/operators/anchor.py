"""Anchoring outline entries to the lines of their page.

Candidates are gathered with DataFrame operations: the entries of each page (as-of join) and its lines with their
canonical forms.  What is left is inherently sequential, as a cursor over the lines moves with every hit, and is done page by page on
one array of lines and one of entries; pages without entries and without bracket lines never reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.functions import text
from waraq.operators.asof import asof
from waraq.operators.outline import PAGES, labelled, numbered, on_pages, repaired
from waraq.shared import frame, spread

FOOTNOTE = "hamesh"
DEEPEST_AUTO = 6
HEADING = (
    "book_id int, page_id int, sub_idx int, ord int, text string, level int, number string, uid string, parent_uid string, positions array<struct<pi:int,li:int>>, "
    "suppress array<struct<pi:int,li:int>>, raw_line string, before_child_slot int, matched boolean, auto boolean, implicit boolean, keep_line boolean, "
    "at_page_top boolean, before_child boolean, bracket_matched boolean"
)

FLAGS = ("matched", "auto", "implicit", "keep_line", "at_page_top", "before_child", "bracket_matched")


@dataclass
class Entry:
    """An outline entry that begins on the page."""

    label: str
    level: int
    number: str
    parent: str | None
    norm: str


@dataclass
class Heading:
    """A heading of a page; the defaults are those of a heading found in the text."""

    text: str
    level: int
    number: str
    uid: str | None = None
    parent_uid: str | None = None
    positions: list[tuple[int, int]] = field(default_factory=list)
    suppress: list[tuple[int, int]] = field(default_factory=list)
    raw_line: str | None = None
    before_child_slot: int | None = None
    matched: bool = False
    auto: bool = False
    implicit: bool = False
    keep_line: bool = False
    at_page_top: bool = False
    before_child: bool = False
    bracket_matched: bool = False


class Lines:
    """Body lines of a page: position, stored text, canonical form.  Footnotes and lines of empty form aren't searched."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        body = [r for r in rows if r["ptype"] != FOOTNOTE]
        self.body = body
        self.searched = [r for r in body if r["norm"]]
        self.at = [(r["pi"], r["li"]) for r in self.searched]
        self.norm = [r["norm"] for r in self.searched]
        self.brackets = {(r["pi"], r["li"]): r["bracket"] for r in body if r["bracket"]}
        self._first: dict[str, list[int]] | None = None

    def find(self, label: str, begin: int) -> tuple[int, int] | None:
        """Span of the first lines from ``begin`` that carry the label.

        Whole lines first (up to three in a row, or a line that begins with a label of at least 4 letters), then a line that begins with the label and goes on
        with no letter or digit, then a line of at least 3 letters with which a longer label begins.
        """
        if not label:
            return None
        n, norm = len(self.norm), self.norm
        words = label.split(" ")
        for k in range(begin, n):
            line = norm[k]
            if line == label or (len(label) >= 4 and line.startswith(label)):
                return k, k + 1
            if label.startswith(line) and len(words) > 1:
                joined = line
                for end in range(k + 1, min(n, k + 3)):
                    joined += " " + norm[end]
                    if joined == label:
                        return k, end + 1
        for k in range(begin, n):
            rest = norm[k][len(label):]
            if rest and norm[k].startswith(label) and not rest[0].isalnum():
                return k, k + 1
        if len(label) >= 4:
            for k in range(begin, n):
                if len(norm[k]) >= 3 and label.startswith(norm[k] + " "):
                    return k, k + 1
        return None


class PageAnchor:
    """Places the entries of one page."""

    def __init__(self, lines: Lines, entries: list[Entry]):
        self.lines = lines
        self.top: list[Heading] = []
        self.placed: list[Heading] = []
        self.waiting: list[Entry] = []
        self.cursor = 0
        for entry in entries:
            self._place(entry)
        self._wait_over(None)
        self._promote_first_line()

    def _span(self, entry: Entry) -> tuple[int, int] | None:
        span = self.lines.find(entry.norm, self.cursor)
        if span is None and (span := self.lines.find(entry.norm, 0)) and span[0] >= self.cursor:
            span = None
        return span

    def _place(self, entry: Entry) -> None:
        span = self._span(entry)
        if span is None:
            self.waiting.append(entry)
            return
        begin, end = span
        heading = Heading(entry.label, entry.level, entry.number, entry.number, entry.parent, self.lines.at[begin:end], matched=True)
        if end - begin == 1 and (line := self.lines.searched[begin]["html"]):
            heading.keep_line = text.says_more(line, entry.norm)
            if not heading.keep_line and not text.in_brackets(line) and text.note_in(line):
                heading.raw_line = text.unwrap_title(line, entry.label)
        if begin == 0 and self.cursor == 0:
            self._wait_over(None)
            heading.suppress = list(heading.positions)
            self._on_top(heading)
        else:
            self._wait_over(heading.positions[0])
            self.placed.append(heading)
        self.cursor = end

    def _on_top(self, heading: Heading) -> None:
        heading.positions, heading.at_page_top = [(0, len(self.top))], True
        self.top.append(heading)
        self.placed.append(heading)

    def _wait_over(self, child: tuple[int, int] | None) -> None:
        """Entries not found in the text go right before the child that was, or to the top of the page."""
        inline = child is not None and not (self.cursor == 0 and child == self.lines.at[0])
        for slot, e in enumerate(self.waiting):
            heading = Heading(e.label, e.level, e.number, e.number, e.parent, implicit=True)
            if inline:
                heading.positions, heading.before_child, heading.before_child_slot = [child], True, slot
                self.placed.append(heading)
            else:
                self._on_top(heading)
        self.waiting = []

    def _promote_first_line(self) -> None:
        """Beside headings on top of the page, one at its first line goes before them."""
        if not self.top or not self.lines.at:
            return
        first = [h for h in self.placed if not h.at_page_top and not h.before_child and h.positions[0] == self.lines.at[0]]
        if not first:
            return
        for h in self.top:
            h.positions = [(p, slot + len(first)) for p, slot in h.positions]
        for slot, h in enumerate(first):
            h.positions, h.at_page_top = [(0, slot)], True
        self.placed = first + [h for h in self.placed if h not in first]


def resolve_page(rows: list[dict], entries: list[Entry], open_number: str | None, open_level: int | None) -> tuple[list[Heading], list[tuple[int, int]]]:
    """Headings of a page in order, and the positions of lines that only repeat one.

    Lines equal to a heading are suppressed unless the heading needs them.  Bracket lines that are no entry become automatic headings below the
    deepest heading.  A child before its parent on one page sends both to the top, parent first.
    """
    lines = Lines(rows)
    located = PageAnchor(lines, entries).placed
    known = {text.anchor_form(h.text) for h in located} - {""}
    taken = {p for h in located for p in h.suppress}
    needed = {p for h in located if h.keep_line for p in h.positions}
    echoes = [p for r in lines.body if (p := (r["pi"], r["li"])) not in taken and p not in needed and p not in lines.brackets and r["norm"] in known]
    taken.update(echoes)
    level, number = (located[-1].level, located[-1].number) if located else (-1, "0") if open_number is None else (open_level, open_number)
    children = sum(e.number.startswith(f"{number}.") and e.number.count(".") == number.count(".") + 1 for e in entries) if number != "0" else 0
    headings, autos = list(located), 0
    for position, label in lines.brackets.items():
        if position in taken:
            continue
        norm = text.anchor_form(label)
        if norm in known:
            taken.add(position)
            owner = next((h for h in headings if not h.auto and text.anchor_form(h.text) == norm), None)
            if owner and position not in owner.suppress:
                owner.suppress.append(position)
            continue
        autos += 1
        headings.append(Heading(label, min(level + 1, DEEPEST_AUTO), str(autos) if number == "0" else f"{number}.{children + autos}", positions=[position], auto=True))
    for h in headings:
        h.bracket_matched = not h.auto and not h.implicit and h.positions[0] in lines.brackets
    headings.sort(key=lambda h: h.positions[0])
    for k in range(len(headings) - 1, -1, -1):
        child = headings[k]
        parent = next((j for j, p in enumerate(headings) if child.parent_uid and p.uid == child.parent_uid and not (p.bracket_matched or p.auto or p.implicit)), None)
        if parent is not None and k < parent:
            headings[parent].at_page_top = child.at_page_top = True
            headings.insert(k, headings.pop(parent))
    return headings, echoes


def page_lines_array(lines: DataFrame) -> DataFrame:
    """(book_id, page_id, sub_idx, lines, has_bracket): the lines of each page in order, with their canonical forms."""
    rows = text.with_line_forms(spread(lines.select("book_id", "page_id", "sub_idx", "pi", "li", "ptype", "html")))
    body = F.col("ptype").isNull() | (F.col("ptype") != FOOTNOTE)
    return rows.groupBy("book_id", "page_id", "sub_idx").agg(F.array_sort(F.collect_list(F.struct("pi", "li", "ptype", "html", "norm", "bracket"))).alias("lines"), F.max(body & F.col("bracket").isNotNull()).alias("has_bracket"))


def page_entries(toc: DataFrame, pages: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled entries by the page on which they begin, as an array; and of every page the deepest heading then open."""
    entries = (numbered(repaired(toc)) if entries is None else entries).where("number IS NOT NULL")
    placed = on_pages(entries, pages).where(F.col("page").isNotNull() & labelled())
    placed = text.with_line_forms(placed.withColumn("label", text.STRIP.column("label")), "label").drop("bracket")
    item = F.struct("page_id", "seq", "label", "level", "number", "parent_number", "norm")
    here = placed.groupBy("book_id", F.col("page").alias("on_page")).agg(F.array_sort(F.collect_list(item)).alias("entries")).withColumnRenamed("on_page", "page_id")
    state = entries.select("book_id", F.col("page_id").alias("key"), F.struct("seq", "open_number").alias("state"))
    opened = asof(pages, state, ["book_id"], "page_id", "key", "state", "open", bucket=PAGES).select("book_id", "page_id", F.col("open.open_number").alias("open_number"))
    return here, opened


def headings(toc: DataFrame, lines: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Headings of every page: columns ``HEADING``; a row with null ``ord`` carries in ``suppress`` the lines that only repeat a heading.

    Entries begin on the first sub-page of their page.  Pages without lines have no headings.  ``entries`` is ``numbered(repaired(toc))`` where that is at hand.
    """
    pages = lines.select("book_id", "page_id").where("book_id IS NOT NULL AND page_id IS NOT NULL").distinct()
    here, opened = page_entries(toc, pages, entries)
    text_of = page_lines_array(lines)
    first = lines.groupBy("book_id", "page_id").agg(F.min("sub_idx").alias("first_sub"))
    rows = text_of.join(opened, ["book_id", "page_id"]).join(here, ["book_id", "page_id"], "left").join(first, ["book_id", "page_id"])
    rows = rows.withColumn("entries", F.when(F.col("sub_idx") == F.col("first_sub"), F.col("entries"))).where("has_bracket OR entries IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                entries = [Entry(e["label"], e["level"], e["number"], e["parent_number"], e["norm"]) for e in (r.entries if r.entries is not None else [])]
                number = r.open_number if isinstance(r.open_number, str) else None
                found, echoes = resolve_page([dict(x) for x in r.lines], entries, number, None if number is None else number.count("."))
                for k, h in enumerate(found):
                    out.append({"book_id": r.book_id, "page_id": r.page_id, "sub_idx": r.sub_idx, "ord": k} | vars(h) | {"positions": _pairs(h.positions), "suppress": _pairs(h.suppress)})
                if echoes:
                    out.append({"book_id": r.book_id, "page_id": r.page_id, "sub_idx": r.sub_idx, "positions": [], "suppress": _pairs(echoes)} | dict.fromkeys(FLAGS, False))
            yield frame(out, HEADING)

    return rows.select("book_id", "page_id", "sub_idx", "lines", "entries", "open_number").mapInPandas(run, HEADING)


def _pairs(positions: list[tuple[int, int]]) -> list[dict]:
    return [{"pi": int(p), "li": int(li)} for p, li in positions]


def page_labels(labels: DataFrame) -> DataFrame:
    """(book_id, page_id, norm): canonical forms of the labels of each page, empty ones included; null labels have none."""
    return labels.where("label IS NOT NULL").select("book_id", "page_id", F.coalesce(text.normalize("label"), F.lit("")).alias("norm")).distinct()


def echo_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines whose canonical form is that of a label of their page: (line_id), set-based."""
    body = spread(lines.where(F.col("ptype").isNull() | (F.col("ptype") != FOOTNOTE)).select("line_id", "book_id", "page_id", "html"))
    body = body.select("line_id", "book_id", "page_id", F.coalesce(text.normalize("html"), F.lit("")).alias("norm"))  # not null, so the join adds no filter that computes it twice
    return body.join(page_labels(labels).where("norm <> ''"), ["book_id", "page_id", "norm"], "left_semi").select("line_id")


def bracket_headings(lines: DataFrame) -> DataFrame:
    """(line_id, book_id, page_id, sub_idx, pi, li, text) of the body lines that are in square brackets as a whole."""
    body = lines.where(F.col("ptype").isNull() | (F.col("ptype") != FOOTNOTE)).where(F.col("html").contains("[") & F.col("html").contains("]"))
    return body.withColumn("text", text.bracket_text("html")).where("text <> ''").select("line_id", "book_id", "page_id", "sub_idx", "pi", "li", "text")


def auto_headings(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Bracket lines that equal no label of their page, numbered within it in document order: (line_id, auto_number)."""
    own = bracket_headings(lines).withColumn("norm", F.coalesce(text.normalize("text"), F.lit("")))
    own = own.join(page_labels(labels), ["book_id", "page_id", "norm"], "left_anti")
    w = Window.partitionBy("book_id", "page_id", "sub_idx").orderBy("pi", "li")  # the lines of one page
    return own.select("line_id", F.row_number().over(w).alias("auto_number"))


def unanchored(headings_: DataFrame) -> DataFrame:
    """(book_id, page_id, sub_idx, entries): of every page with any, its entries that stand nowhere in its text, (ord, label, level, number) in order.

    Of headings that were renumbered, or numbered by volume, the entries show those numbers and the pages they moved to.
    """
    item = F.struct("ord", F.col("text").alias("label"), "level", "number")
    return headings_.where("implicit AND ord IS NOT NULL").groupBy("book_id", "page_id", "sub_idx").agg(F.array_sort(F.collect_list(item)).alias("entries"))  # of one page
