"""Queries of the HTML parsers, over pages written out as the site delivers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.functions.text import escape_html, extract_id
from waraq.plans import sqltext as q
from waraq.sources import html, table


def landed_pages(pages: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html) as delivered; book_id is the delivery, so that each keeps its own document."""
    kind = lambda p: F.when(p["type"] == "hamesh", "hamesh").when(p["type"] == "heading", "head").otherwise("")
    body = F.array_join(F.transform(F.coalesce("paragraphs", F.array()), lambda p: F.concat(F.lit('<p class="'), kind(p), F.lit('">'), F.array_join(p["lines"], "<br>"), F.lit("</p>"))), "")
    box = F.concat(F.lit('<div class="nass"><div data-page-id="'), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit('" data-page-num="'), F.coalesce(F.col("page_num").cast("string"), F.lit("")),
                   F.lit('" data-next-id="'), F.coalesce((F.col("url_page_id") + 1).cast("string"), F.lit("")), F.lit('">'), body, F.lit("</div></div>"))
    return pages.select(F.col("delivery_id").alias("book_id"), "url_page_id", F.coalesce(box, F.lit("")).alias("html"))


def landed_outlines(toc: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html): each book's outline as nested lists with links; an entry is in the list of the last one above it with a lesser level."""
    link = F.concat(F.lit('<li><a href="/book/'), F.col("book_id").cast("string"), F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("x")), F.lit('">'), escape_html("label"), F.lit("</a>"))
    items = toc.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", link.alias("li")))).alias("items"))

    def nest(state, x):
        open_ = F.filter(state["open"], lambda level: level < x["level"])
        closed = F.size(state["open"]) - F.size(open_)
        before = F.when(closed == 0, "<ul>").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ul></li>"), closed - 1)))
        return F.struct(F.concat(state["html"], F.array(F.concat(before, x["li"]))).alias("html"), F.concat(open_, F.array(x["level"])).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("html"), F.array().cast("array<int>").alias("open"))
    whole = F.aggregate("items", start, nest, lambda s: F.concat(F.array_join(s["html"], ""), F.repeat(F.lit("</li></ul>"), F.size(s["open"]))))
    return items.select("book_id", F.lit(None).cast("int").alias("url_page_id"), F.concat(F.lit('<div class="betaka-index">'), whole, F.lit("</div>")).alias("html"))


def landed_cards(books: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html): home pages with the book's card, the links to its category and its author."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), escape_html(c), F.lit("<br>"))) for name, c in html.CARD.items()]
    crumbs = F.when(F.col("category_id").isNotNull(), F.concat(F.lit('<ol class="breadcrumb"><li><a href="/category/'), F.col("category_id"), F.lit('">'), escape_html("category_name"), F.lit("</a></li></ol>")))
    by = F.when(F.col("author_url").isNotNull(), F.concat(F.lit('<a href="'), F.col("author_url"), F.lit('">'), escape_html("author"), F.lit("</a>")))
    page = F.concat_ws("", crumbs, F.lit('<div class="nass">'), *lines, F.lit("</div>"), by)
    return books.select("book_id", F.lit(None).cast("int").alias("url_page_id"), page.alias("html"))


def _gathered(rows: DataFrame, key: str, order: str, item) -> DataFrame:
    """(key, url_page_id, html): the items of each key in order."""
    own = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("html")))), lambda x: x["html"]), "").alias("html"))
    return own.select(F.col(key).alias("book_id"), F.lit(1).alias("url_page_id"), "html")


def landed_volumes(volumes: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html): the volume menu of each book."""
    link = F.concat(F.lit('<li><a href="/book/'), F.col("book_id"), F.lit("/"), F.coalesce(F.col("start_page").cast("string"), F.lit("x")), F.lit('">'), escape_html("label"), F.lit("</a></li>"))
    menus = _gathered(volumes, "book_id", "ord", link)
    return menus.withColumn("html", F.concat(F.lit('<ul class="dropdown-menu">'), "html", F.lit("</ul>")))


def landed_categories(books: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html): the listing of each category, by book."""
    by = F.when(F.col("author_url").isNotNull(), F.concat(F.lit('<a href="'), F.col("author_url"), F.lit('">['), escape_html("author"), F.lit("]</a>")))
    item = F.concat_ws("", F.lit('<div class="book_item"><a href="/book/'), F.col("book_id"), F.lit('"><span class="book_title">'), escape_html("title"), F.lit("</span></a>"), by, F.lit("</div>"))
    return _gathered(books.where("category_id IS NOT NULL"), "category_id", "book_id", item)


def landed_authors(books: DataFrame) -> DataFrame:
    """(book_id, url_page_id, html): the page of each author, with a word on them and their books."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} "), escape_html(c), F.lit("<br>"))) for name, c in html.LISTING.items() if c != "title"]
    item = F.concat_ws("", F.lit('<div class="book_item"><a href="/book/'), F.col("book_id"), F.lit('"><span class="book_title">'), escape_html("title"), F.lit("</span></a><p>"), *lines, F.lit("</p></div>"))
    rows = books.where("author_url IS NOT NULL").withColumn("_author", extract_id("author_url", "author"))
    pages = _gathered(rows, "_author", "book_id", item)
    about = F.concat(F.lit('<h4>تعريف بالمؤلف</h4><div class="alert">author '), F.col("book_id"), F.lit("<br>second line</div>"))
    return pages.withColumn("html", F.concat(about, "html"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return landed_pages(table(s, d, "pages"))


QUERIES = {
    "html_pages": lambda s, d: html.extract(_pages(s, d), "pages").select(F.col("book_id").alias("delivery_id"), "page_id", "page_num", F.size("paragraphs").alias("n_paragraphs"),
        F.size(F.filter("paragraphs", lambda p: p["type"] == "heading")).alias("n_headings"), F.size(F.filter("paragraphs", lambda p: p["type"] == "hamesh")).alias("n_notes")),
    "html_links": lambda s, d: html.extract(_pages(s, d), "links").select(F.col("book_id").alias("delivery_id"), "next_id"),
    "html_outline": lambda s, d: html.extract(landed_outlines(table(s, d, "toc")), "toc").select(F.col("book_id").cast("int").alias("book_id"), "seq", "level", "label", "page_id"),
    "html_lines": lambda s, d: html.extract(_pages(s, d), "pages").select(F.col("book_id").alias("delivery_id"), F.posexplode("paragraphs").alias("pi", "p")).select("delivery_id", "pi", "p.type", F.posexplode("p.lines").alias("li", "line")),
    "html_books": lambda s, d: html.extract(landed_cards(table(s, d, "books")), "books").drop("url_page_id").withColumn("book_id", F.col("book_id").cast("int")),
    "html_volumes": lambda s, d: html.extract(landed_volumes(table(s, d, "volumes")), "volumes").select(F.col("book_id").cast("int").alias("book_id"), "ord", "start_page", "label"),
    "html_category_books": lambda s, d: html.unseen_listing(html.extract(landed_categories(table(s, d, "books")), "category_books")).select(F.col("book_id").cast("int").alias("category_id"), "pos", "listed_id", "title", "author_id", "author_name"),
    "html_authors": lambda s, d: html.extract(landed_authors(table(s, d, "books")), "authors").select(F.col("book_id").cast("int").alias("author_id"), "full_name", "bio"),
    "html_author_books": lambda s, d: html.extract(landed_authors(table(s, d, "books")), "author_books").select(F.col("book_id").cast("int").alias("author_id"), "pos", "listed_id", "title", "author", "publisher", "edition", "pages", "editor"),
}

_AUTHOR = "try_cast(nullif(regexp_extract(author_url, '/author/([0-9]+)', 1), '') AS INT)"
# A stored line as the parser shows it: coloured spans set aside, entities resolved, all else escaped, the spans put back with their colours.
_SHOWN = q.bare("regexp_replace(" + q.escaped(q.plain(r"""regexp_replace(replace(line, '</span>', chr(2)), '<span class="c([1-5])">', chr(1) || '\1', 'g')""")) + ", chr(2), '</span>', 'g')")
for _k, _colour in enumerate(("#5f0000", "#005300", "#686800", "#707070", "#005c81"), 1):
    _SHOWN = f"""replace({_SHOWN}, chr(1) || '{_k}', '<span style="color:{_colour}">')"""
_COUNT = "len([p for p in paragraphs if p.type = '{}' AND len([x for x in p.lines if x <> '']) > 0])::INT"
SQL = {
    "html_links": "SELECT delivery_id, url_page_id + 1 AS next_id FROM pages",
    "html_pages": f"SELECT delivery_id, page_id, page_num, {_COUNT.format('heading')} + {_COUNT.format('hamesh')} + {_COUNT.format('text')} AS n_paragraphs, {_COUNT.format('heading')} AS n_headings, {_COUNT.format('hamesh')} AS n_notes "
                  "FROM pages WHERE len(paragraphs) > 0",
    "html_outline": f"""WITH above AS (SELECT a.book_id, a.seq, count(b.seq) AS level FROM toc a LEFT JOIN toc b ON b.book_id = a.book_id AND b.seq < a.seq AND b.level < a.level
    AND NOT EXISTS (SELECT 1 FROM toc c WHERE c.book_id = a.book_id AND c.seq > b.seq AND c.seq < a.seq AND c.level <= b.level) GROUP BY 1, 2)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY seq) - 1)::INT AS seq, x.level::INT AS level, coalesce({q.bare('label')}, '') AS label, page_id FROM toc JOIN above x USING (book_id, seq)""",
    "html_lines": f"""WITH p AS (SELECT delivery_id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) AS i FROM pages),
l AS (SELECT delivery_id, i, p.type, unnest(p.lines) AS line, generate_subscripts(p.lines, 1) AS li FROM p),
shown AS (SELECT delivery_id, i, type, li, {_SHOWN} AS line FROM l),
kept AS (SELECT delivery_id, i, type, line, li FROM shown WHERE line <> '' AND type = 'hamesh'
  UNION ALL SELECT delivery_id, i, type, {q.bare("string_agg(line, '<br>' ORDER BY li)")}, 1 FROM shown WHERE type <> 'hamesh' GROUP BY 1, 2, 3)
SELECT delivery_id, (dense_rank() OVER (PARTITION BY delivery_id ORDER BY i) - 1)::INT AS pi, type, (row_number() OVER (PARTITION BY delivery_id, i ORDER BY li) - 1)::INT AS li, line FROM kept WHERE line <> ''""",
    "html_books": f"""SELECT book_id, {', '.join(f"{q.bare(c)} AS {c}" for c in ('title', 'author', 'publisher', 'edition', 'volumes', 'pages', 'editor'))},
  category_id, CASE WHEN category_id IS NOT NULL THEN coalesce({q.bare('category_name')}, '') END AS category_name, {_AUTHOR}::VARCHAR AS author_id, author_url FROM books""",
    "html_volumes": f"""WITH f AS (SELECT book_id, start_page, min(ord) AS o, arg_min(label, ord) AS label FROM (SELECT book_id, start_page, ord, coalesce(label, '') AS label FROM volumes WHERE start_page IS NOT NULL) GROUP BY 1, 2)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY o) - 1)::INT AS ord, start_page, {q.bare('label')} AS label FROM f""",
    "html_category_books": f"""SELECT category_id, (row_number() OVER (PARTITION BY category_id ORDER BY book_id) - 1)::INT AS pos, book_id AS listed_id, coalesce({q.bare('title')}, '') AS title, {_AUTHOR} AS author_id,
  CASE WHEN author_url IS NOT NULL THEN coalesce({q.bare('author')}, '') END AS author_name FROM books WHERE category_id IS NOT NULL""",
    "html_authors": f"SELECT DISTINCT {_AUTHOR} AS author_id, 'author ' || {_AUTHOR} AS full_name, 'author ' || {_AUTHOR} || chr(10) || 'second line' AS bio FROM books WHERE author_url IS NOT NULL",
    "html_author_books": f"""SELECT {_AUTHOR} AS author_id, (row_number() OVER (PARTITION BY {_AUTHOR} ORDER BY book_id) - 1)::INT AS pos, book_id AS listed_id, coalesce({q.bare('title')}, '') AS title,
  {', '.join(f"{q.bare(c)} AS {c}" for c in ('author', 'publisher', 'edition', 'pages', 'editor'))} FROM books WHERE author_url IS NOT NULL""",
}
