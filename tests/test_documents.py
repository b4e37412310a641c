"""Headings as documents show them: anchored, then in document order, then by volume, then rendered."""

from datetime import datetime

from waraq.operators import anchor, renumber, volumes
from waraq.plans.texts import QUERIES

TOC = "toc_id bigint, book_id int, seq int, level int, label string, page_id int"
LINES = "line_id bigint, book_id int, page_id int, sub_idx int, pi int, li int, ptype string, html string"
VOLUMES = "book_id int, start_page int, ord int, label string"


def heading(book, page, ord_, text, number, pi, parent=None, level=None, sub=0, top=False, suppress=(), **flags):
    base = {"auto": False, "implicit": False} | flags
    return (book, page, sub, ord_, text, number.count(".") if level is None else level, number, None if base["auto"] else number, parent, [(pi, 0)], list(suppress), None, None, True,
            base["auto"], base["implicit"], False, top, False, False)


def test_moved_heading_takes_the_place_of_the_automatic_one(spark):
    rows = [heading(1, 1, 0, "a", "1", 0), heading(1, 2, 0, "قسم", "1.2", 0, "1", implicit=True, top=True), heading(1, 3, 0, "b", "1.1", 0, "1", suppress=[(4, 0)]),
            heading(1, 4, 0, "قسم", "1.1.1", 2, auto=True), heading(1, 4, 1, "c", "1.3", 5, "1"), heading(2, 1, 0, "x", "1", 0, top=True)]
    echo = (1, 2, 0, None, None, None, None, None, None, [], [(7, 0)], None, None, False, False, False, False, False, False, False)
    got = renumber.in_document_order(spark.createDataFrame([*rows, echo], anchor.HEADING))
    assert [f.name for f in got.schema] == [f.name for f in spark.createDataFrame([], anchor.HEADING).schema]
    seen = {(r.book_id, r.page_id, r.ord): (r.text, r.number, [tuple(p) for p in r.positions], [tuple(p) for p in r.suppress], r.at_page_top, r.implicit) for r in got.collect()}
    assert seen == {
        (1, 1, 0): ("a", "1", [(0, 0)], [], False, False), (1, 3, 0): ("b", "1.1", [(0, 0)], [(4, 0)], False, False), (1, 4, 1): ("c", "1.3", [(5, 0)], [], False, False),
        (1, 4, 2): ("قسم", "1.2", [(2, 0)], [(2, 0)], False, True), (1, 2, None): (None, None, [], [(7, 0)], False, False), (2, 1, 0): ("x", "1", [(0, 0)], [], True, False)}


def numbered(spark, rows, prefix=False):
    bounds = volumes.merged(volumes.bounds(spark.createDataFrame([(1, 1, 0, "1"), (1, 10, 1, "2"), (2, 1, 0, "1")], VOLUMES)))
    got = volumes.numbered_headings(spark.createDataFrame(rows, anchor.HEADING), bounds, prefix)
    return {(r.book_id, r.page_id, r.sub_idx, r.text): (r.number, r.level_in_volume, r.skipped) for r in got.collect()}


def test_headings_are_numbered_by_volume(spark):
    rows = [heading(1, 2, 0, "a", "1", 0), heading(1, 10, 0, "c", "1.1", 0, "1", sub=1), heading(1, 10, 0, "b", "1.2", 0, "1"), heading(1, 11, 0, "q", "1.2.1", 0, auto=True),
            heading(1, 12, 0, "q", "1.2.1", 0, "1.2", implicit=True), heading(1, 13, 0, "r", "1.3.2.1.1", 0), heading(2, 5, 0, "x", "3", 0)]
    assert numbered(spark, rows) == {
        (1, 2, 0, "a"): ("1", 0, False), (1, 10, 0, "b"): ("1", 0, False), (1, 10, 1, "c"): ("2", 0, False), (1, 11, 0, "q"): ("2.1", 1, False), (1, 12, 0, "q"): ("2.1", 1, True),
        (1, 13, 0, "r"): ("2.1.1.1", 3, False), (2, 5, 0, "x"): ("3", None, False)}
    assert numbered(spark, rows, True) == {
        (1, 2, 0, "a"): ("1.1", 0, False), (1, 10, 0, "b"): ("2.1", 0, False), (1, 10, 1, "c"): ("2.2", 0, False), (1, 11, 0, "q"): ("2.2.1", 1, False), (1, 12, 0, "q"): ("2.2.1", 1, True),
        (1, 13, 0, "r"): ("", 3, False), (2, 5, 0, "x"): ("3", None, False)}


def test_page_html_shows_the_final_headings(spark, tmp_path):
    toc = [(1, 1, 0, 0, "باب النحو", 1), (2, 1, 1, 1, "قسم غائب", 2), (3, 1, 2, 1, "فصل باء", 3), (4, 1, 3, 1, "فصل جيم", 3), (5, 2, 0, 0, "كتاب أول", 1), (6, 2, 1, 0, "كتاب ثان", 3)]
    lines = [(1, 1, "باب النحو"), (1, 2, "كلام"), (1, 3, "مقدم"), (1, 3, "فصل جيم"), (1, 3, "فصل باء"), (1, 4, "نص"), (1, 4, "[قسم غائب]"), (2, 1, "كتاب أول"), (2, 3, "كتاب ثان")]
    seen: dict = {}
    body = [(k, b, p, 0, seen.setdefault((b, p), []).append(0) or len(seen[b, p]) - 1, 0, "text", html) for k, (b, p, html) in enumerate(lines)]
    spark.createDataFrame(toc, TOC).write.parquet(f"{tmp_path}/toc.parquet")
    spark.createDataFrame(body, LINES).write.parquet(f"{tmp_path}/page_lines.parquet")
    spark.createDataFrame([(2, 1, 0, "1"), (2, 3, 1, "2")], VOLUMES).write.parquet(f"{tmp_path}/volumes.parquet")
    pages = [(1, 1, None, 0, datetime(2024, 1, 1), "not shown"), (2, 9, None, 0, datetime(2024, 1, 2), "later"), (3, 9, 4, 0, datetime(2024, 1, 1), "a < b\n\n \n\nc"), (4, None, 9, 0, datetime(2024, 1, 1), "z")]
    spark.createDataFrame([(k, 1, *r) for k, *r in pages], "delivery_id bigint, book_id int, page_id int, url_page_id int, sub_idx int, received_at timestamp, text string").write.parquet(f"{tmp_path}/pages.parquet")
    html = {(r.book_id, r.page_id): r.html for r in QUERIES["page_html"](spark, str(tmp_path)).collect()}
    mark = lambda level, label: f'<p class="toc-bookmark-anchor toc-bm-{level}">{label}</p>'
    assert mark(1, "1.1. فصل جيم") in html[1, 3] and mark(1, "1.2. فصل باء") in html[1, 3]
    assert "قسم غائب</p>" not in html[1, 2] and mark(1, "1.3. قسم غائب") in html[1, 4] and html[1, 4].count("toc-bookmark-anchor") == 1
    assert mark(0, "1. كتاب ثان") in html[2, 3] and ">1</div>" in html[2, 3]
    assert "not shown" not in html[1, 1] and html[1, 9].endswith("<p>a &lt; b</p><p>c</p></div></div>")
