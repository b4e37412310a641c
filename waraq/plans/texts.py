"""Queries of text functions, anchoring and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.functions import text as t
from waraq.operators import anchor, outline, render, renumber, volumes
from waraq.plans import sqltext as q
from waraq.shared import spread, written
from waraq.sources import table


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_lines")


def _toc(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "toc").select("toc_id", "book_id", "seq", "level", "label", "page_id")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """Numbered outline entries, written, as headings and running titles both come from them."""
    return written(outline.numbered(outline.repaired(_toc(s, d))), "outline-entries")


def _headings(s: SparkSession, d: str, entries: DataFrame | None = None) -> DataFrame:
    return anchor.headings(_toc(s, d), _lines(s, d), entries)


def _final(s: SparkSession, d: str, prefix: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """The headings as documents show them: in document order, then by volume."""
    return volumes.numbered_headings(renumber.in_document_order(_headings(s, d, entries)), volumes.merged(volumes.bounds(table(s, d, "volumes"))), prefix)


def _rendered(s: SparkSession, d: str) -> DataFrame:
    lines, entries = _lines(s, d), _entries(s, d)
    pages = table(s, d, "pages").select("book_id", F.coalesce("page_id", "url_page_id").alias("page_id"), "sub_idx", "received_at", "delivery_id", "text").where("page_id IS NOT NULL AND text IS NOT NULL")
    texts = volumes.first_wins(pages, ["book_id", "page_id", "sub_idx"], ["received_at", "delivery_id"])
    return render.rendered(lines, _final(s, d, entries=entries), outline.page_outline(_toc(s, d), lines, entries), texts)


_PLACE = ["book_id", "page_id", "sub_idx", "ord"]


QUERIES = {
    "plain_lines": lambda s, d: _lines(s, d).select("line_id", t.plain_text("html").alias("plain")),
    "normalized_lines": lambda s, d: spread(_lines(s, d).select("line_id", "html")).select("line_id", t.normalize("html").alias("norm")),
    "normalized_labels": lambda s, d: _toc(s, d).select("toc_id", t.normalize("label").alias("norm")),
    "escaped_labels": lambda s, d: _toc(s, d).select("toc_id", t.escape_html("label").alias("escaped")),
    "truncated_titles": lambda s, d: _toc(s, d).select("toc_id", t.truncate_title("label").alias("short")),
    "safe_names": lambda s, d: table(s, d, "books").select("book_id", t.safe_name("title").alias("safe_title"), t.safe_name("category_name", 20).alias("safe_category")),
    "uncoloured_lines": lambda s, d: _lines(s, d).select("line_id", t.strip_title_colour("html").alias("body")),
    "noted_lines": lambda s, d: _lines(s, d).where(t.has_note("html")).select("line_id"),
    "dotted_lines": lambda s, d: _lines(s, d).where(~F.coalesce(t.STRIP.column(t.plain_text("html")).rlike(t.DOTS_ONLY), F.lit(False))).groupBy("ptype").agg(F.count("*").alias("n_lines")),
    "extracted_ids": lambda s, d: table(s, d, "books").select("book_id", t.extract_id("url", "book").alias("url_book"), t.extract_id("author_url", "author").alias("url_author"), t.digits("pages").alias("n_pages"), t.digits("volumes").alias("n_volumes")),
    "bracket_headings": lambda s, d: anchor.bracket_headings(_lines(s, d)).select("line_id", "text"),
    "echo_lines": lambda s, d: anchor.echo_lines(_lines(s, d), _toc(s, d)),
    "auto_numbers": lambda s, d: anchor.auto_headings(_lines(s, d), _toc(s, d)),
    "lines_beyond_labels": lambda s, d: _lines(s, d).join(_toc(s, d).where("label IS NOT NULL").select("toc_id", "book_id", "page_id", "label"), ["book_id", "page_id"]).where(
        F.col("html").startswith(F.col("label")) & t.has_extra_content("html", "label")).select("toc_id", "line_id"),
    "page_headings": lambda s, d: _headings(s, d).where("ord IS NOT NULL"),
    "page_echoes": lambda s, d: _headings(s, d).where("ord IS NULL").select("book_id", "page_id", "sub_idx", F.explode("suppress").alias("p")).select("book_id", "page_id", "sub_idx", "p.*"),
    "unanchored_entries": lambda s, d: anchor.unanchored(renumber.in_document_order(_headings(s, d))).select("book_id", "page_id", "sub_idx", F.explode("entries").alias("e")).select("book_id", "page_id", "sub_idx", "e.*"),
    "heading_volume_numbers": lambda s, d: _final(s, d).where("level_in_volume IS NOT NULL").select(*_PLACE, "text", "auto", "level_in_volume", "number"),
    "heading_volume_numbers_prefixed": lambda s, d: _final(s, d, True).where("level_in_volume IS NOT NULL").select(*_PLACE, "text", "auto", "level_in_volume", "number"),
    "skipped_headings": lambda s, d: _final(s, d).where("skipped").select(*_PLACE, "text", "number"),
    "renumbering_gate": lambda s, d: renumber.needs_renumbering(_headings(s, d)),
    "renumbered_headings": lambda s, d: renumber.with_page_order(renumber.renumbered(_headings(s, d))).select("book_id", "page_id", "sub_idx", "ord", "pi", "li", "text", "level", "number"),
    "page_html": _rendered,
}

_digits = lambda c: f"try_cast(nullif(regexp_extract(translate({c}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '([0-9]+)', 1), '') AS INT)"
_BRACKETS = f"SELECT line_id, book_id, page_id, sub_idx, pi, li, {q.inside('html')} AS text FROM page_lines WHERE ptype IS DISTINCT FROM 'hamesh' AND {q.in_brackets('html')} AND {q.inside('html')} <> ''"
_LABELS = f"SELECT DISTINCT book_id, page_id, {q.normal('label')} AS norm FROM toc"

SQL = {
    "plain_lines": f"SELECT line_id, {q.plain('html')} AS plain FROM page_lines",
    "normalized_lines": f"SELECT line_id, {q.normal('html')} AS norm FROM page_lines",
    "normalized_labels": f"SELECT toc_id, {q.normal('label')} AS norm FROM toc",
    "escaped_labels": f"SELECT toc_id, {q.escaped('label')} AS escaped FROM toc",
    "truncated_titles": f"SELECT toc_id, {q.shortened('label')} AS short FROM toc",
    "safe_names": f"SELECT book_id, {q.safe_name('title')} AS safe_title, {q.safe_name('category_name', 20)} AS safe_category FROM books",
    "uncoloured_lines": f"SELECT line_id, {q.uncoloured('html')} AS body FROM page_lines",
    "noted_lines": f"SELECT line_id FROM page_lines WHERE {q.is_noted('html')}",
    "dotted_lines": f"SELECT ptype, count(*) AS n_lines FROM page_lines WHERE NOT coalesce(regexp_full_match({q.bare(q.plain('html'))}, '[.]+'), false) GROUP BY 1",
    "extracted_ids": "SELECT book_id, try_cast(nullif(regexp_extract(url, '/book/([0-9]+)', 1), '') AS INT) AS url_book, try_cast(nullif(regexp_extract(author_url, '/author/([0-9]+)', 1), '') AS INT) AS url_author, "
                     f"{_digits('pages')} AS n_pages, {_digits('volumes')} AS n_volumes FROM books",
    "lines_beyond_labels": f"SELECT t.toc_id, l.line_id FROM page_lines l JOIN toc t ON l.book_id = t.book_id AND l.page_id = t.page_id WHERE starts_with(l.html, t.label) AND {q.says_more('l.html', 't.label')}",
    "bracket_headings": f"SELECT line_id, text FROM ({_BRACKETS})",
    "echo_lines": f"WITH known AS ({_LABELS}) SELECT line_id FROM page_lines l WHERE ptype IS DISTINCT FROM 'hamesh' AND EXISTS (SELECT 1 FROM known k WHERE k.norm <> '' AND k.book_id = l.book_id AND k.page_id = l.page_id AND k.norm = {q.normal('l.html')})",
    "auto_numbers": f"WITH known AS ({_LABELS}), b AS (SELECT *, {q.normal('text')} AS norm FROM ({_BRACKETS})) SELECT line_id, row_number() OVER (PARTITION BY book_id, page_id, sub_idx ORDER BY pi, li)::INT AS auto_number FROM b "
                    "WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.book_id = b.book_id AND k.page_id = b.page_id AND k.norm = b.norm)",
}
