from waraq.operators import anchor, outline, render, renumber
from waraq.operators.anchor import Entry, Lines, resolve_page
from waraq.functions import text as t

TOC = "toc_id bigint, book_id int, seq int, level int, label string, page_id int"
LINES = "line_id bigint, book_id int, page_id int, sub_idx int, pi int, li int, ptype string, html string"


def rows(*lines):
    out = []
    for pi, x in enumerate(lines):
        ptype, html = x if isinstance(x, tuple) else ("text", x)
        inner = t._strip(t._plain(html)).strip("[]") if t.in_brackets(html) else None
        out.append({"pi": pi, "li": 0, "ptype": ptype, "html": html, "norm": t.anchor_form(inner or html), "bracket": inner})
    return out


def entries(*pairs):
    return [Entry(label, number.count("."), number, parent, t.anchor_form(label)) for label, number, parent in pairs]


def resolve(lines, *pairs, opened=None):
    found, echoes = resolve_page(rows(*lines), entries(*pairs), opened, opened.count(".") if opened else None)
    return found, echoes


def test_heading_at_the_start_goes_to_the_top():
    (h,), _ = resolve(["باب النحو", "كلام"], ("باب النحو", "1", None))
    assert h.at_page_top and h.positions == [(0, 0)] and h.suppress == [(0, 0)] and not h.keep_line


def test_inline_heading_keeps_the_rest_of_its_line():
    (h,), _ = resolve(["كلام سابق", "اسمه: زيد بن عمرو بن خالد"], ("اسمه", "1", None))
    assert h.positions == [(1, 0)] and h.keep_line and not h.at_page_top


def test_missing_parent_goes_before_its_child():
    (p, c), _ = resolve(["كلام", "الفصل الأول"], ("الباب المفقود", "1", None), ("الفصل الأول", "1.1", "1"))
    assert (p.text, p.implicit, p.before_child, p.before_child_slot, p.positions) == ("الباب المفقود", True, True, 0, [(1, 0)])
    assert c.matched and c.positions == [(1, 0)]


def test_unmatched_at_the_end_is_implicit_on_top():
    (h,), _ = resolve(["كلام"], ("غائب", "1", None))
    assert h.implicit and h.at_page_top


def test_label_over_three_lines_and_short_labels():
    lines = Lines(rows("باب", "في", "النحو", "٦ - قول"))
    assert lines.find(t.normal("باب في النحو"), 0) == (0, 3)
    assert Lines(rows("٦٧ شيء", "نص")).find("٦", 0) is None
    assert Lines(rows("مهمة", "نص")).find(t.normal("مهمة: توجيه القول"), 0) == (0, 1)


def test_cursor_goes_back_for_a_child_before_its_parent():
    found, _ = resolve(["مقدم", "ملخص البحث", "المقدمة"], ("المقدمة", "1", None), ("ملخص البحث", "1.1", "1"))
    assert [(h.text, h.at_page_top) for h in found] == [("المقدمة", True), ("ملخص البحث", True)]


def test_bracket_lines():
    found, echoes = resolve(["[الفصل]", "كلام", "[قسم جديد]", "الفصل", ("hamesh", "[حاشية]")], ("الفصل", "2", None), opened="2")
    assert [(h.text, h.auto, h.number, h.level) for h in found] == [("الفصل", False, "2", 0), ("قسم جديد", True, "2.1", 1)]
    assert found[0].bracket_matched and echoes == [(3, 0)]
    (a,), _ = resolve(["[وحده]"])
    assert (a.number, a.level) == ("1", 0)


def test_label_of_notes_only_is_found():
    (h,), _ = resolve(["كلام", "[(باب العصبات)]"], ("(باب العصبات)", "1", None))
    assert h.matched and h.positions == [(1, 0)]


def tables(spark, toc, lines):
    return spark.createDataFrame(toc, TOC), spark.createDataFrame([(k, *r) for k, r in enumerate(lines)], LINES)


def test_pages_end_to_end(spark):
    toc, lines = tables(spark, [(1, 1, 0, 0, "باب النحو", 1), (2, 1, 1, 1, "فصل <ب>", 2)], [
        (1, 1, 0, 0, 0, "heading", "باب النحو"), (1, 1, 0, 1, 0, "text", "كلام"), (1, 1, 0, 2, 0, "hamesh", "(١) حاشية"), (1, 2, 0, 0, 0, "text", "[تفصيل]"), (1, 2, 0, 0, 1, "text", None), (2, 1, 0, 0, 0, "text", "")])
    heads = anchor.headings(toc, lines)
    got = sorted((r.page_id, r.ord, r.text, r.number, r.auto, r.implicit) for r in heads.collect())
    assert got == [(1, 0, "باب النحو", "1", False, False), (2, 0, "فصل <ب>", "1.1", False, True), (2, 1, "تفصيل", "1.1.1", True, False)]
    html = {(r.book_id, r.page_id): r.html for r in render.rendered(lines, heads, outline.page_outline(toc, lines)).collect()}
    assert html[1, 1].count("باب النحو") == 3 and '<div class="hamesh"><p>(١) حاشية</p></div>' in html[1, 1] and "<p>كلام</p>" in html[1, 1]
    assert "فصل &lt;ب&gt;" in html[1, 2] and "[تفصيل]" not in html[1, 2] and len(html) == 3


def test_empty_tables(spark):
    toc, lines = tables(spark, [], [])
    heads = anchor.headings(toc, lines)
    assert heads.collect() == [] and renumber.renumbered(heads).collect() == []


def heading(book, page, ord_, text, number, pi, parent=None, **flags):
    base = {"auto": False, "implicit": False, "bracket_matched": False} | flags
    uid = None if base["auto"] else number
    return (book, page, 0, ord_, text, number.count("."), number, uid, parent, [(pi, 0)], [], None, None, False, base["auto"], base["implicit"], False, False, False, base["bracket_matched"])


def numbers(spark, rows_):
    df = spark.createDataFrame(rows_, anchor.HEADING)
    return {(r.page_id, r.text): r.number for r in renumber.renumbered(df).collect()}


def test_books_in_order_are_left_alone(spark):
    assert numbers(spark, [heading(1, 1, 0, "a", "1", 0), heading(1, 2, 0, "b", "1.1", 0, "1"), heading(1, 3, 0, "c", "2", 0)]) == {}


def test_sibling_inversion_is_renumbered(spark):
    got = numbers(spark, [heading(1, 1, 0, "a", "1", 0), heading(1, 2, 0, "c", "1.2", 0, "1"), heading(1, 3, 0, "b", "1.1", 0, "1"), heading(2, 1, 0, "x", "1", 0)])
    assert got == {(1, "a"): "1", (2, "c"): "1.1", (3, "b"): "1.2"}


def test_child_before_bracketed_parent_becomes_its_sibling(spark):
    got = numbers(spark, [heading(1, 1, 0, "child", "1.1", 0, "1"), heading(1, 1, 1, "parent", "1", 1, bracket_matched=True)])
    assert got == {(1, "child"): "1", (1, "parent"): "2"}


def test_implicit_moves_to_its_automatic_heading(spark):
    rows_ = [heading(1, 1, 0, "a", "1", 0), heading(1, 2, 0, "قسم", "1.2", 0, "1", implicit=True), heading(1, 3, 0, "b", "1.1", 0, "1"), heading(1, 4, 0, "قسم", "1.1.1", 2, auto=True)]
    assert numbers(spark, rows_) == {(1, "a"): "1", (3, "b"): "1.1", (4, "قسم"): "1.2"}
