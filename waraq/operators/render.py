"""HTML of resolved pages.

Lines and headings of a page meet in one array each, and every page is rendered on its own; a document is the
pages of a (book, volume) written in order, one part file per range of pages, never gathered in one row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.functions import text
from waraq.operators.anchor import FOOTNOTE

_TITLE_COLOUR = re.compile(text.as_python(text.TITLE_COLOUR.steps[0][1])).sub
# Markup that the style sheets of the documents select, and the style of boxes that only set running titles.
_SETTER, _ENTRY, _TEXT, _NOTE, _LINE_OF_HEADING = "bm-setter", "page-entry", "page-text", "hamesh", "chapter-heading"
_BOOKMARK, _BOOKMARK_LEVEL, _SHOWN, _SHOWN_LEVEL = "toc-bookmark-anchor", "toc-bm-", "toc-numbered-heading", "toc-nh-"
_HIDDEN = "position:absolute;left:-9999px;top:-9999px;width:1px;height:1px;overflow:hidden;font-size:0"


def bookmark_level(level: int) -> int:
    """Level of the bookmark of an outline level; the title of the book and its volumes come before."""
    return level + 2


def bookmark_styles(deepest: int) -> str:
    """Style rules that make bookmarks of headings of levels 0 to ``deepest``."""
    return "\n".join(f".{_BOOKMARK_LEVEL}{k} {{ bookmark-level: {bookmark_level(k)}; bookmark-label: content(); }}" for k in range(deepest + 1))


def _box(tag: str, css: str, inner: str, **attributes: str) -> str:
    more = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f'<{tag}{f' class="{css}"' if css else ""}{more}>{inner}</{tag}>'


def _heading(h: dict) -> str:
    """Bookmark of a heading, and its line unless it is implicit."""
    if h["implicit"] and h.get("skipped"):
        return ""
    own = h["level"] if h.get("level_in_volume", -1) < 0 else h["level_in_volume"]
    level, label = int(own), html_lib.escape(h["text"])  # null levels beside it make the level a float
    numbered = ". ".join(x for x in (h["number"], label) if x) if h["number"] else label
    shown = "" if h["implicit"] else _box("p", f"{_SHOWN} {_SHOWN_LEVEL}{level}", h["raw_line"] or label)
    return _box("p", f"{_BOOKMARK} {_BOOKMARK_LEVEL}{level}", numbered) + shown


def _line(html: str, ptype: str) -> str:
    return _box("p", _LINE_OF_HEADING if ptype == "heading" else "", html)


def _remainder(html: str, headings: list[dict]) -> str:
    body = _TITLE_COLOUR("", html, count=1).strip()
    for h in headings:
        rest = text.without_heading(body, h["text"])
        if rest and rest != body:
            return rest
    return body


def _body_line(line: str, ptype: str, here: list[dict], dropped: bool) -> str:
    """A body line with the headings before it; beside a heading of its own only what it says beyond that."""
    before = "".join(_heading(h) for h in sorted(here, key=lambda h: (not h["before_child"], h["before_child_slot"] or 0)))
    own = [h for h in here if not h["implicit"] and not h["before_child"]]
    if own:
        rest = _remainder(line, own) if any(h["keep_line"] for h in own) else ""
        return before + (_line(rest, ptype) if rest else "")
    return before + ("" if dropped and not here else _line(line, ptype))


def page_html(lines: list[dict], headings: list[dict], echoes: set[tuple[int, int]], number: str, breadcrumb: str, text_: str | None = None) -> str:
    """One page: running titles, headings on top, then each line with the headings before it.

    Footnotes stay as they are, the lines of one in a box.  At a heading found in the text the line gives way, or shows what it says beyond the heading; beside artificial headings it is
    shown; lines that only repeat a heading are dropped.  A page without lines shows its ``text_``, a paragraph at a time.
    """
    titles = "".join(_box("div", _SETTER, html_lib.escape(value), style=f"{_HIDDEN};string-set:{name} content()") for name, value in (("chapter-title", breadcrumb), ("toc-number", number)) if value)
    inline = [h for h in headings if not h["at_page_top"]]
    place = lambda p: (p["pi"], p["li"])
    dropped = set(echoes) | {place(p) for h in headings for p in h["positions"][1:]}
    dropped |= {place(s) for h in headings for s in h["suppress"] if not (h["at_page_top"] and h["keep_line"] and place(s) == place(h["positions"][0]))}
    at: dict[tuple[int, int], list[dict]] = {}
    for h in inline:
        at.setdefault(place(h["positions"][0]), []).append(h)
    out = [_heading(h) for h in headings if h["at_page_top"]] if lines else []
    for note, rows in groupby(lines, key=lambda r: r["pi"] if r["ptype"] == FOOTNOTE else None):
        stored = [(r, line) for r in rows if (line := (r["html"] or "").strip()) or note is not None]
        if note is None:
            out += [_body_line(line, r["ptype"], at.get(place(r), []), place(r) in dropped) for r, line in stored]
        else:
            out.append(_box("div", _NOTE, "".join(_box("p", "", line) for _, line in stored if line)))
    if not lines:
        out = [_box("p", "", html_lib.escape(chunk)) for x in (text_ or "").split("\n\n") if (chunk := x.strip())]
    return titles + (_box("div", _ENTRY, _box("div", _TEXT, "".join(out))) if lines or out else "")


def range_of(headings: list[dict]) -> str:
    """First and last number of a page's headings numbered by volume, automatic ones aside; empty without any."""
    numbers = [h["number"] for h in headings if h["level_in_volume"] >= 0 and h["number"] and not h["auto"]]
    return "-".join((numbers[0], numbers[-1]) if len(numbers) > 1 else numbers)


def rendered(lines: DataFrame, headings: DataFrame, outline: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(book_id, page_id, sub_idx, html) of every page of ``lines``; ``outline`` gives toc_number and toc_breadcrumb by page.

    ``texts``: (book_id, page_id, sub_idx, text), a row a page; those of pages without lines are shown as they are.

    ``headings`` may be numbered by volume (``volumes.numbered_headings``); their pages show the range of those numbers.
    """
    key = ["book_id", "page_id", "sub_idx"]
    if "level_in_volume" not in headings.columns:
        headings = headings.withColumns({"level_in_volume": F.lit(None).cast("int"), "skipped": F.lit(False)})
    body = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pi", "li", "ptype", "html"))).alias("lines")).withColumn("text", F.lit(None).cast("string"))
    if texts is not None:
        body = body.unionByName(texts.select(*key, "text").join(lines.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    fields = ["ord", "text", "level", "number", "positions", "suppress", "raw_line", "before_child_slot", "auto", "implicit", "keep_line", "at_page_top", "before_child", F.coalesce("level_in_volume", F.lit(-1)).alias("level_in_volume"), "skipped"]
    heads = headings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("headings"))
    rows = body.join(heads, key, "left").join(outline, ["book_id", "page_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for r in batch.itertuples(index=False):
                heads = [dict(h) for h in r.headings] if r.headings is not None else []
                echoes = {(p["pi"], p["li"]) for h in heads if h["ord"] is None for p in h["suppress"]}
                heads = [h for h in heads if h["ord"] is not None]
                pages.append(page_html([dict(x) for x in r.lines] if r.lines is not None else [], heads, echoes, range_of(heads) or r.toc_number or "", r.toc_breadcrumb or "", r.text))
            yield batch[key].assign(html=pages)

    return rows.mapInPandas(run, "book_id int, page_id int, sub_idx int, html string")


def write_documents(pages: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Pages as text files below ``path``/book_id=.../, in page order; a large book is several part files."""
    by = by or ["book_id"]
    parts = pages.repartitionByRange(*by, "page_id", "sub_idx").sortWithinPartitions(*by, "page_id", "sub_idx")
    parts.select(*by, "html").write.mode("overwrite").partitionBy(*by).text(path)
