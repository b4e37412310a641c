from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waraq.operators import catalog
from waraq.sources import html, jsonl
from waraq.streaming import ingest

HOME = """<html><body><ol class="breadcrumb"><li><a href="/">x</a><li><a href="/category/14">التاريخ</a></ol><a href="/author/102">المؤلف</a>
<div class="nass">الكتاب: تاريخ: كبير<br>المؤلف: زيد<br>عدد الصفحات: ٢٨٢<br>غير: ذلك</div>
<div class="betaka-index"><ul><li><a class="exp_bu" href="javascript:;" data-id="7">+</a><a href="/book/5/1">باب <b>أول</b></a><ul><li><a href="/book/5/2">فصل</a><li><a href="/book/5/x">بلا رقم</a></ul>
<li><a class="exp_bu" data-id="9" href="javascript:;">+</a><a href="/book/5/8">باب ثان</a></li><li>لا رابط</li></ul></div>
<ul class="dropdown-menu"><li><a href="/book/5/1">١</a><li><a href="/book/5/40">م 2</a><li><a href="/book/5/1">again</a></ul></body></html>"""
PAGE = """<div class="nass"><div data-page-id="1" data-page-num="5" data-next-id="2"><p class="head">عنوان<p>نص <span class="c2">ملون</span> و<i>مائل</i> &lt; <br>سطر<p>...<p><p class="hamesh">(١) أ<br>(٢) ب</div>
<div data-page-id=""><p>ثان</div></div><a href="/book/5/9">9</a><a href="/book/5/44">44</a><a href="/book/6/99">other</a>"""
BARE = '<div class="betaka-index"><ul><li><a href="/book/5/1">١</a><li><a href="/book/5/2">2</a></ul></div><div class="s-nav"><ul><li><a href="/book/5/3">باب</a></li></ul></div>'
AUTHOR = """<div class="alert">banner</div><div><h4>تعريف بالمؤلف</h4></div><div class="alert">زيد بن عمرو<br>ولد سنة</div>
<div class="book_item"><a href="/book/5"><span class="book_title">عنوان</span></a><p>الكتاب: كتاب كبير<br>الناشر: دار<br>دراسة وتحقيق: بكر</p></div>"""
CATEGORY = '<div class="book_item"><a href="/book/5">خمسة</a> <a href="/author/3">[زيد]</a></div><div class="book_item"><a href="/other">x</a></div><div class="book_item"><a href="/book/6"><span class="book_title">ستة</span></a></div>'


def raw(spark, *documents):
    return spark.createDataFrame([(5, k, d, "clash") for k, d in enumerate(documents)], "book_id int, url_page_id int, html string, label string")


def test_outline_and_lazy_children(spark):
    toc = html.extract(raw(spark, HOME), "toc")
    rows = sorted(toc.collect(), key=lambda r: r.seq)
    assert [(r.level, r.label, r.page_id, r.lazy_id, r.n_children) for r in rows] == [
        (0, "بابأول", 1, "7", 2), (1, "فصل", 2, None, 0), (1, "بلا رقم", None, None, 0), (0, "باب ثان", 8, "9", 0), (0, None, None, None, 0)]
    assert html.has_lazy([r.asDict() for r in rows])
    more = spark.createDataFrame([(5, "9", 0, 0, "فرع", 9), (5, "9", 1, 1, "فرع الفرع", 10), (5, "7", 0, 0, "delivered already", 3)], "book_id int, lazy_id string, seq int, level int, label string, page_id int")
    full = sorted(html.with_lazy_children(toc, more).collect(), key=lambda r: r.seq)
    assert [(r.level, r.label) for r in full] == [(0, "بابأول"), (1, "فصل"), (1, "بلا رقم"), (0, "باب ثان"), (1, "فرع"), (2, "فرع الفرع"), (0, None)]


def test_other_places_of_the_outline(spark):
    heading = "<h4>فهرس الموضوعات</h4><p>x</p><div><ul><li><a href='/book/5/3'>باب</a></ul></div>"
    named = "<div id='my-TOC'><section><ul><li><a href='/book/5/4'>باب</a></ul></section></div>"
    got = html.extract(raw(spark, BARE, heading, named, "", None, "<ul><li>no"), "toc").collect()
    assert sorted((r.url_page_id, r.page_id) for r in got) == [(0, 3), (1, 3), (2, 4)]


def test_card_and_volumes(spark):
    b = html.extract(raw(spark, HOME), "books").first()
    assert (b.title, b.author, b.pages, b.category_id, b.category_name, b.author_id, b.publisher) == ("تاريخ: كبير", "زيد", "٢٨٢", 14, "التاريخ", "102", None)
    assert sorted((r.ord, r.start_page, r.label) for r in html.extract(raw(spark, HOME), "volumes").collect()) == [(0, 1, "١"), (1, 40, "م 2")]


def test_pages_and_links(spark):
    one, two = sorted(html.extract(raw(spark, PAGE), "pages").collect(), key=lambda r: r.sub_idx)
    assert (one.page_id, one.page_num, two.page_id) == (1, 5, None)
    assert [(p.type, p.lines) for p in one.paragraphs] == [("heading", ["عنوان"]), ("text", ['نص <span style="color:#005300">ملون</span> ومائل &lt; <br>سطر']), ("hamesh", ["(١) أ", "(٢) ب"])]
    assert one.text == "عنوان\n\nنص ملون ومائل < سطر\n\n(١) أ\n(٢) ب"
    links = html.extract(raw(spark, PAGE, '<button id="bu_load_next" data-next-id="7">', ""), "links").collect()
    assert sorted((r.url_page_id, r.next_id, r.last_id) for r in links) == [(0, 2, 44), (1, 7, None), (2, None, None)]
    fallback = html.extract(raw(spark, '<div class="nass"><div>short</div><div>نص طويل بما يكفي ليعد صفحة</div></div>'), "pages").collect()
    assert [(r.page_id, r.text) for r in fallback] == [(None, "نص طويل بما يكفي ليعد صفحة")]


def test_author_and_category(spark):
    a = html.extract(raw(spark, AUTHOR), "authors").first()
    assert (a.full_name, a.bio) == ("زيد بن عمرو", "زيد بن عمرو\nولد سنة")
    b = html.extract(raw(spark, AUTHOR), "author_books").first()
    assert (b.listed_id, b.title, b.publisher, b.editor) == (5, "كتاب كبير", "دار", "بكر")
    rows = sorted(html.extract(raw(spark, CATEGORY), "category_books").collect(), key=lambda r: r.pos)
    assert [(r.listed_id, r.title, r.author_id, r.author_name) for r in rows] == [(5, "خمسة", 3, "زيد"), (6, "ستة", None, None)]


def test_listing_stops_at_a_page_without_news(spark):
    pages = [(1, 1, 0, 10), (1, 1, 1, 11), (1, 2, 0, 11), (1, 2, 1, 12), (1, 3, 0, 10), (1, 4, 0, 13)]
    df = spark.createDataFrame(pages, "book_id int, url_page_id int, pos int, listed_id int")
    assert sorted(r.listed_id for r in html.unseen_listing(df).collect()) == [10, 11, 12]


def test_deep_and_long_documents(spark):
    deep = "<div class='toc'>" + "<ul><li><a href='/book/5/1'>x</a>" * 3000
    long = "<div data-page-id='1'><p>" + "ب " * 500_000 + "</div>"
    assert html.extract(raw(spark, deep), "toc").count() == 3000
    assert len(html.extract(raw(spark, long), "pages").first().text) > 900_000


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "pages.jsonl")
    lines = ['{"book_id": 1, "url_page_id": 4, "paragraphs": [{"type": "text", "lines": ["a"]}]}', "", "  ", '{"book_id": 1, "page_id": 9}', '{"cut', '{"book_id": 1, "url_page_id": "x"}']
    (tmp_path / "pages.jsonl").write_text("\n".join(lines))
    got = jsonl.scan_jsonl(spark, path).first()
    assert (got.max_page_id, got.n_lines) == (9, 4)
    rows = jsonl.read_jsonl(spark, path).collect()
    assert sorted(str(r.url_page_id) for r in rows) == ["4", "None"] and rows[0].paragraphs[0].lines == ["a"]
    default = spark.createDataFrame([(0,)], "a int")
    assert jsonl.read_json(spark, str(tmp_path / "absent.json"), "a int", default).first().a == 0
    (tmp_path / "bad.json").write_text("{")
    assert jsonl.read_json(spark, str(tmp_path / "bad.json"), "a int", default).first().a == 0
    out = str(tmp_path / "out")
    jsonl.append_jsonl(spark.createDataFrame([(1, 2)], "book_id int, url_page_id int"), out)
    jsonl.append_jsonl(spark.createDataFrame([(1, 3)], "book_id int, url_page_id int"), out)
    assert jsonl.read_jsonl(spark, out).count() == 2
    jsonl.write_json(spark.createDataFrame([(1, 5)], "book_id int, url_page_id int"), out)
    assert jsonl.read_jsonl(spark, out).count() == 2


def test_replaced_json_is_whole(spark, tmp_path):
    out = f"file://{tmp_path}/current"
    of = lambda n: spark.createDataFrame([(k, n) for k in range(n)], "book_id int, url_page_id int")
    with pytest.raises(FileNotFoundError):
        jsonl.read_current(spark, out)
    for n in (1, 4, 2):
        jsonl.write_json(of(n), out)
        assert [r.url_page_id for r in jsonl.read_current(spark, out).collect()] == [n] * n
    with pytest.raises(Exception):
        jsonl.write_json(of(1).select(F.raise_error(F.lit("lost")).cast("int").alias("book_id")), out)
    assert jsonl.read_current(spark, out).count() == 2
    with pytest.raises(Exception):
        jsonl.read_json(spark, str(tmp_path / "absent.json"), "no schema at all (", spark.range(1))


def test_stream_resumes_and_keeps_one_of_each(spark, tmp_path):
    schema = "delivery_id bigint, book_id int, page_id int, url_page_id int, sub_idx int, received_at timestamp"
    t = datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: ingest.land(ingest.first_deliveries(ingest.page_stream(spark, src, spark.read.parquet(src).schema)), out, cp)
    spark.createDataFrame([(1, 1, 1, 1, 0, t), (2, 1, 1, 1, 0, t), (3, 1, None, 2, 0, t), (4, 1, None, None, 0, t)], schema).coalesce(1).write.parquet(src)
    run()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(5, 1, 2, 2, 0, t), (6, 1, 3, 3, 0, t)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.number) for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_queue(spark):
    a = spark.createDataFrame([(5, "cat", 2), (6, "cat", 1), (5, "cat2", 3), (None, "x", 1)], "book_id int, category_label string, pos int")
    b = spark.createDataFrame([(6,), (7,), (8,)], "book_id int")
    done = spark.createDataFrame([(8,)], "book_id int")
    assert sorted(map(tuple, catalog.queue([a, b], done).collect())) == [(5, 0, "cat"), (6, 0, "cat"), (7, 1, None)]


def test_chain_ends_and_cycles(spark):
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(1, 40)] + [(1, 40, None), (2, 1, 2), (2, 2, 3), (2, 3, 1), (3, 5, 5)], "book_id int, page_id int, next_id int")
    starts = spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, 1)], "book_id int, page_id int")
    got = sorted(map(tuple, catalog.chain(edges, starts).collect()))
    assert got == [(1, k, k - 1) for k in range(1, 41)] + [(2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 5, 0), (4, 1, 0)]


def test_resume_points(spark):
    expected = spark.createDataFrame([(1, k) for k in range(1, 8)] + [(2, 1), (3, 1)], "book_id int, page_id int")
    received = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 4), (2, 1)], "book_id int, page_id int")
    cursor = spark.createDataFrame([(1, 3), (2, 9)], "book_id int, next_page_id int")
    got = {r.book_id: tuple(r)[1:] for r in catalog.resume_points(expected, received, cursor).collect()}
    assert got == {1: (3, 4, 2, 5), 2: (1, 1, 1, 9), 3: (0, None, None, 1)}


def test_outline_and_volumes_fall_back_to_the_first_page(spark):
    page = '<div class="s-nav"><ul><li><a href="/book/{0}/3">باب</a></li></ul></div><ul class="dropdown-menu"><li><a href="/book/{0}/1">م</a></ul>'
    homes = spark.createDataFrame([(5, None, BARE.split('<div class="s-nav">')[0]), (6, None, "<p>none</p>"), (7, None, HOME.replace("/book/5/", "/book/7/"))], "book_id int, url_page_id int, html string")
    pages = spark.createDataFrame([(b, n, page.format(b)) for b in (5, 6, 7) for n in (2, 4)] + [(6, 1, None)], "book_id int, url_page_id int, html string")
    labels = {}
    for r in html.outlines(homes, pages).collect():
        labels.setdefault(r.book_id, []).append(r.label)
    assert labels[5] == ["باب"] and labels[6] == ["باب"] and "فصل" in labels[7]
    assert {r.book_id for r in html.volumes_of_books(homes, pages).collect()} == {5, 6, 7}


def test_status_of_books(spark):
    expected = spark.createDataFrame([(b, p) for b in (1, 2, 3, 4) for p in (1, 2, 3)], "book_id int, page_id int")
    received = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 2)], "book_id int, page_id int")
    runs = spark.createDataFrame([(2, 1, "interrupted", None), (2, 2, "error", "lost"), (3, 5, "interrupted", None), (1, 9, "error", "late")], "book_id int, ended_at int, outcome string, error string")
    got = {r.book_id: (r.status, r.next_page_id, r.pages_scraped, r.error) for r in catalog.ingest_status(expected, received, runs).collect()}
    assert got == {1: ("done", 4, 2, None), 2: ("error", 2, 1, "lost"), 3: ("paused", 3, 1, None), 4: ("in_progress", 1, 0, None)}
