"""Parsers of landed HTML, one row of HTML to many rows.

``raw_html`` holds (book_id, url_page_id, kind, html): kind is home, page, category, author or toc_child.  Parsing is the
one step that needs Python; it is a narrow pass over Arrow batches, one document in memory at a time.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import COLOURS
from waraq.shared import frame

# Labels of a book's card and of a listing's description; words that mark sections.
CARD = {"الكتاب": "title", "المؤلف": "author", "الناشر": "publisher", "الطبعة": "edition", "عدد الأجزاء": "volumes", "عدد الصفحات": "pages", "المحقق": "editor"}
LISTING = {"الكتاب:": "title", "المؤلف:": "author", "الناشر:": "publisher", "الطبعة:": "edition", "عدد الصفحات:": "pages", "دراسة وتحقيق:": "editor"}
INDEX_WORD, BIO_WORD = "فهرس", "تعريف"
INDEX_NAMES = ("fihris", "index", "toc", "contents")
NOTE_CLASSES, HEADING_CLASSES = {"hamesh", "footnote"}, {"b", "head", "title"}
# Classes, ids and attributes of the site's markup.
INDEX_BOX, SIDEBAR, CARD_BOX, CRUMBS, MENU, ITEM, ITEM_TITLE, NOTICE = "betaka-index", "s-nav", "nass", "breadcrumb", "dropdown-menu", "book_item", "book_title", "alert"
EXPAND, EXPAND_ID, PAGE_ID, PAGE_NUM, NEXT_ID, NEXT_BUTTON = "exp_bu", "data-id", "data-page-id", "data-page-num", "data-next-id", "bu_load_next"
#: Share of labels without letters from which an outline counts as bare page numbers.
BARE_SHARE = 0.8
#: Shortest text that counts as a page where the page markup is missing.
LEAST_TEXT = 20

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that an opening tag ends implicitly.
_ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = frozenset("div ul ol table section article header footer h1 h2 h3 h4 h5 h6 blockquote pre form hr".split())
_SCOPES = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}


class Node:
    """An element; children are elements and strings in document order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str, where: Callable[[Node], bool] = lambda n: True) -> Iterator[Node]:
        return (n for n in self.walk() if (not tags or n.tag in tags) and where(n))

    def first(self, *tags: str, where: Callable[[Node], bool] = lambda n: True) -> Node | None:
        return next(self.all(*tags, where=where), None)

    def own(self, *tags: str) -> list[Node]:
        """Direct children of the tags."""
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]

    def strings(self) -> list[str]:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                stack.extend(reversed(c.children))
        return out

    def text(self, between: str = "", strip: bool = True) -> str:
        parts = self.strings()
        return between.join(t for p in parts if (t := p.strip())) if strip else between.join(parts)

    def after(self) -> list[Node]:
        """Elements that follow it in its parent."""
        if self.parent is None:
            return []
        own = self.parent.children
        at = next(k for k, c in enumerate(own) if c is self)
        return [c for c in own[at + 1 :] if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.here
        closing = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        stop = _SCOPES.get(tag, set())
        probe = node
        while closing and probe.parent is not None and probe.tag not in stop:
            if probe.tag in closing:
                self.here = probe.parent
                break
            if probe.tag in _BLOCKS and probe.tag not in closing and "p" in closing and tag not in _SCOPES:
                break
            probe = probe.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(child)
        if tag not in _VOID:
            self.here = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(document: str) -> Node:
    """Tree of an HTML document; open elements are closed as browsers do for lists, paragraphs and tables."""
    builder = _Builder()
    builder.feed(document)
    builder.close()
    return builder.root


def number_in(address: str | None, kind: str, second: bool = False) -> int | None:
    """Number after ``/kind/`` in an address, or the one after it."""
    m = re.search(rf"/{kind}/(\d+)" + (r"/(\d+)" if second else ""), address or "")
    return int(m[2 if second else 1]) if m else None


def outline(ul: Node | None) -> list[dict]:
    """Entries of a nested list in depth-first order: (seq, level, label, page_id, lazy_id, n_children)."""
    rows: list[dict] = []
    stack = [(li, 0) for li in reversed(ul.own("li"))] if ul else []
    while stack:
        li, level = stack.pop()
        links = list(li.all("a"))
        title = next((a for a in links if EXPAND not in a.classes and a.attrs.get("href")), None)
        lazy = [a.attrs.get(EXPAND_ID) for a in links if EXPAND in a.classes]
        below = [x for u in li.own("ul")[:1] for x in u.own("li")]
        rows.append({"seq": len(rows), "level": level, "label": title.text() if title else None, "page_id": number_in(title.attrs["href"], "book", True) if title else None,
                     "lazy_id": lazy[-1] or None if lazy else None, "n_children": len(below)})
        stack.extend((x, level + 1) for x in reversed(below))
    return rows


def is_bare(rows: list[dict]) -> bool:
    """Whether an outline is empty or nearly all of its labels are digits."""
    bare = sum(bool(r["label"]) and re.fullmatch(r"[\d\s]+", r["label"].strip()) is not None for r in rows)
    return not rows or bare >= BARE_SHARE * len(rows)


def has_lazy(rows: list[dict]) -> bool:
    """Whether some entry has children that were not delivered with it."""
    return any(r["lazy_id"] and not r["n_children"] for r in rows)


def outline_list(root: Node) -> Node | None:
    """The list that holds the outline of a home page: the index box, the list after an index heading, or any box named like an index."""
    box = root.first("div", where=lambda n: INDEX_BOX in n.classes)
    if box and box.own("ul"):
        return box.own("ul")[0]
    for heading in root.all("h3", "h4", "h5", where=lambda n: INDEX_WORD in n.text()):
        for sibling in heading.after():
            if sibling.tag in ("h3", "h4", "h5"):
                break
            found = sibling if sibling.tag == "ul" else sibling.first("ul") if sibling.tag in ("div", "section") else None
            if found:
                return found
    for div in root.all("div", where=lambda n: any(k in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower() for k in INDEX_NAMES)):
        if found := div.first("ul"):
            return found
    return None


def sidebar_list(root: Node) -> Node | None:
    """The outline in the sidebar of a content page."""
    bar = root.first("div", where=lambda n: SIDEBAR in n.classes)
    return next(iter(bar.own("ul")), None) if bar else None


def volume_links(root: Node) -> list[dict]:
    """(ord, start_page, label) of the volume menu, the first of equal pages."""
    seen: dict[int, str] = {}
    for menu in root.all("ul", where=lambda n: MENU in n.classes):
        for a in menu.all("a"):
            if (page := number_in(a.attrs.get("href"), "book", True)) is not None:
                seen.setdefault(page, a.text())
    return [{"ord": k, "start_page": p, "label": t} for k, (p, t) in enumerate(seen.items())]


def card(root: Node) -> dict:
    """Fields of a book's home page."""
    out: dict = {}
    box = root.first("div", where=lambda n: CARD_BOX in n.classes)
    for line in box.text("\n").splitlines() if box else []:
        name, found, value = line.partition(":")
        if found and name.strip() in CARD:
            out[CARD[name.strip()]] = value.strip()
    crumbs = root.first("ol", where=lambda n: CRUMBS in n.classes)
    link = crumbs.first("a", where=lambda n: "/category/" in n.attrs.get("href", "")) if crumbs else None
    if link and (number := number_in(link.attrs["href"], "category")) is not None:
        out |= {"category_id": number, "category_name": link.text()}
    author = root.first("a", where=lambda n: number_in(n.attrs.get("href"), "author") is not None)
    if author:
        out |= {"author_url": author.attrs["href"], "author_id": str(number_in(author.attrs["href"], "author"))}
    return out


def author(root: Node) -> tuple[dict, list[dict]]:
    """(full_name, bio) and the books of an author's page."""
    box = None
    for h in root.all("h4", where=lambda n: BIO_WORD in n.text()):
        box = next((n for n in h.parent.after() if NOTICE in n.classes), None)
        break
    if box is None:
        box = next(reversed(list(root.all("div", where=lambda n: NOTICE in n.classes))), None)
    bio = box.text("\n") if box else None
    lines = [t for x in (bio or "").splitlines() if (t := x.strip())]
    books = []
    for item in root.all("div", where=lambda n: ITEM in n.classes):
        row: dict = {}
        if a := item.first("a", where=lambda n: "href" in n.attrs):
            row |= {"url": a.attrs["href"], "book_id": number_in(a.attrs["href"], "book")}
        if span := item.first("span", where=lambda n: ITEM_TITLE in n.classes):
            row["title"] = span.text()
        if p := item.first("p"):
            for line in p.text("\n").splitlines():
                for prefix, key in LISTING.items():
                    if line.strip().startswith(prefix):
                        row[key] = line.replace(prefix, "").strip()
        if row:
            books.append(row)
    return {"full_name": lines[0] if lines else None, "bio": bio}, books


def category(root: Node) -> list[dict]:
    """(pos, book_id, title, author_id, author_name) of one page of a category."""
    rows = []
    for item in root.all("div", where=lambda n: ITEM in n.classes):
        link = item.first("a", where=lambda n: number_in(n.attrs.get("href"), "book") is not None)
        if not link:
            continue
        title = item.first("span", where=lambda n: ITEM_TITLE in n.classes)
        by = item.first("a", where=lambda n: number_in(n.attrs.get("href"), "author") is not None)
        rows.append({"pos": len(rows), "book_id": number_in(link.attrs["href"], "book"), "title": (title or link).text(),
                     "author_id": number_in(by.attrs["href"], "author") if by else None, "author_name": by.text().strip("[]").strip() if by else None})
    return rows


def inline(p: Node) -> str:
    """A paragraph as a fragment: line breaks and coloured spans stay, all else is escaped text."""
    out = []
    for c in p.children:
        if isinstance(c, str):
            out.append(html_lib.escape(c))
        elif c.tag == "br":
            out.append("<br>")
        else:
            body = html_lib.escape(c.text(" ", strip=False))
            colour = next((COLOURS[k] for k in c.classes if k in COLOURS), None) if c.tag == "span" else None
            out.append(f'<span style="color:{colour}">{body}</span>' if colour else body)
    return "".join(out).strip()


def flat(fragment: str) -> str:
    """Text of a fragment, pieces joined with blanks."""
    return parse(fragment).text(" ")


def _as_int(value: str) -> int | None:
    return int(value) if value and value.strip().isdigit() else None


def pages(root: Node) -> list[dict]:
    """(sub_idx, page_id, page_num, paragraphs, text) of the pages in a document; paragraphs of nothing but dots are dropped."""
    rows = []
    for div in root.all("div", where=lambda n: PAGE_ID in n.attrs):
        paragraphs = []
        for p in div.all("p"):
            body = inline(p)
            if not body or re.fullmatch(r"\.+", flat(body).strip()):
                continue
            kinds = set(p.classes)
            if kinds & NOTE_CLASSES:
                if lines := [t for x in re.split(r"<br\s*/?>", body) if (t := x.strip())]:
                    paragraphs.append({"type": "hamesh", "lines": lines})
            else:
                paragraphs.append({"type": "heading" if kinds & HEADING_CLASSES else "text", "lines": [body]})
        if paragraphs:
            rows.append({"page_id": _as_int(div.attrs[PAGE_ID]), "page_num": _as_int(div.attrs.get(PAGE_NUM, "")), "paragraphs": paragraphs,
                         "text": "\n\n".join("\n".join(flat(x) for x in p["lines"]) for p in paragraphs)})
    if not rows and (box := root.first("div", where=lambda n: CARD_BOX in n.classes)):
        for div in box.own("div"):
            if len(t := div.text(" ")) > LEAST_TEXT:
                rows.append({"page_id": None, "page_num": None, "paragraphs": [{"type": "text", "lines": [html_lib.escape(t)]}], "text": t})
    return [r | {"sub_idx": k} for k, r in enumerate(rows)]


def next_page(root: Node) -> int | None:
    """Number of the next page, from the page's own box or the button that loads it."""
    for node in (root.first("div", where=lambda n: PAGE_ID in n.attrs), root.first("button", where=lambda n: n.attrs.get("id") == NEXT_BUTTON)):
        if node is not None and (n := _as_int(node.attrs.get(NEXT_ID, ""))) is not None:
            return n
    return None


def last_page(root: Node, book_id: int) -> int | None:
    """Greatest page number among the links of a page to its book."""
    found = [int(m[1]) for a in root.all("a") if (m := re.search(rf"/book/{book_id}/(\d+)", a.attrs.get("href", "")))]
    return max(found, default=None)


SCHEMAS = {
    "toc": "book_id bigint, url_page_id int, seq int, level int, label string, page_id int, lazy_id string, n_children int",
    "sidebar": "book_id bigint, url_page_id int, seq int, level int, label string, page_id int, lazy_id string, n_children int",
    "volumes": "book_id bigint, url_page_id int, ord int, start_page int, label string",
    "books": "book_id bigint, url_page_id int, title string, author string, publisher string, edition string, volumes string, pages string, editor string, category_id int, category_name string, author_id string, author_url string",
    "pages": "book_id bigint, url_page_id int, sub_idx int, page_id int, page_num int, paragraphs array<struct<type:string,lines:array<string>>>, text string",
    "links": "book_id bigint, url_page_id int, next_id int, last_id int",
    "category_books": "book_id bigint, url_page_id int, pos int, listed_id int, title string, author_id int, author_name string",
    "authors": "book_id bigint, url_page_id int, full_name string, bio string",
    "author_books": "book_id bigint, url_page_id int, pos int, listed_id int, url string, title string, author string, publisher string, edition string, pages string, editor string",
}


def _rows(what: str, book_id: int, document: str) -> list[dict]:
    root = parse(document)
    if what == "toc":
        found = outline(outline_list(root))
        return found if not is_bare(found) or is_bare(side := outline(sidebar_list(root))) else side
    if what == "sidebar":
        return outline(sidebar_list(root))
    if what == "volumes":
        return volume_links(root)
    if what == "books":
        return [card(root)]
    if what == "pages":
        return pages(root)
    if what == "links":
        return [{"next_id": next_page(root), "last_id": last_page(root, book_id)}]
    if what == "category_books":
        return [r | {"listed_id": r.pop("book_id")} for r in category(root)]
    info, listed = author(root)
    return [info] if what == "authors" else [r | {"pos": k, "listed_id": r.pop("book_id", None)} for k, r in enumerate(listed)]


def extract(raw: DataFrame, what: str) -> DataFrame:
    """Table ``what`` of ``SCHEMAS`` out of landed HTML; null documents give no rows.

    For categories and authors book_id is their own id and ``listed_id`` the book's.  A home page whose outline is bare falls back to the sidebar, if there
    is one in it.
    """
    schema = SCHEMAS[what]
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for book, page, document in zip(batch["book_id"].astype("Int64"), batch["url_page_id"].astype("Int64"), batch["html"]):
                if document is not None:
                    out += [{"book_id": book, "url_page_id": page} | r for r in _rows(what, book, document)]
            yield frame(out, schema)

    return raw.select(F.col("book_id").cast("bigint").alias("book_id"), F.col("url_page_id").cast("int").alias("url_page_id"), "html").where("html IS NOT NULL").mapInPandas(run, schema)


def first_of_book(raw: DataFrame) -> DataFrame:
    """The landed page of each book with the least number."""
    return raw.where("html IS NOT NULL").groupBy("book_id").agg(F.min_by(F.struct("url_page_id", "html"), F.struct("url_page_id")).alias("_p")).select("book_id", "_p.*")


def outlines(homes: DataFrame, pages_: DataFrame) -> DataFrame:
    """Outline of every book: that of its home page, or where that is bare the one in the sidebar of its first content page unless that is bare too."""
    own = extract(homes, "toc")
    bare = F.coalesce(F.col("label").rlike(r"^\s*[0-9\x{0660}-\x{0669}][0-9\x{0660}-\x{0669}\s]*$"), F.lit(False))
    share = lambda toc: toc.groupBy("book_id").agg((F.count_if(bare) >= BARE_SHARE * F.count("*")).alias("bare"))
    good = share(own).where("NOT bare").select("book_id")
    side = extract(first_of_book(pages_).join(good, "book_id", "left_anti"), "sidebar")
    chosen = share(side).where("NOT bare").select("book_id")
    return own.join(chosen, "book_id", "left_anti").unionByName(side.join(chosen, "book_id", "left_semi"))


def volumes_of_books(homes: DataFrame, pages_: DataFrame) -> DataFrame:
    """Volume menu of every book: that of its home page, or where it has none that of its first content page."""
    own = extract(homes, "volumes")
    return own.unionByName(extract(first_of_book(pages_).join(own.select("book_id").distinct(), "book_id", "left_anti"), "volumes"))


def with_lazy_children(toc: DataFrame, children: DataFrame) -> DataFrame:
    """Outline of home pages with the entries that were delivered apart put below theirs, numbered anew.

    ``children``: (book_id, lazy_id, seq, level, label, page_id), levels counted from 0 below the entry named by lazy_id.  Entries whose children never came stay as they are.
    """
    from pyspark.sql import Window

    parents = toc.where("lazy_id IS NOT NULL AND n_children = 0").select("book_id", "lazy_id", F.col("seq").alias("_above"), F.col("level").alias("_level"))
    new = children.join(parents, ["book_id", "lazy_id"]).select("book_id", F.col("_above").alias("_a"), (F.col("seq") + 1).alias("_b"), (F.col("_level") + 1 + F.col("level")).cast("int").alias("level"), "label", "page_id")
    old = toc.select("book_id", F.col("seq").alias("_a"), F.lit(0).alias("_b"), "level", "label", "page_id")
    w = Window.partitionBy("book_id").orderBy("_a", "_b")
    return old.unionByName(new).select("book_id", (F.row_number().over(w) - 1).alias("seq"), "level", "label", "page_id")


def unseen_listing(listing: DataFrame) -> DataFrame:
    """Books of a category over its pages, each once where it is first listed; pages after the first one that brings nothing new count no more."""
    first = listing.groupBy("book_id", "listed_id").agg(F.min(F.struct("url_page_id", "pos")).alias("at"))
    fresh = first.groupBy("book_id", F.col("at.url_page_id").alias("url_page_id")).agg(F.count("*").alias("n"))
    dry = listing.select("book_id", "url_page_id").distinct().join(fresh, ["book_id", "url_page_id"], "left").where("n IS NULL").groupBy("book_id").agg(F.min("url_page_id").alias("dry"))
    rows = listing.join(first.select("book_id", "listed_id", "at"), ["book_id", "listed_id"]).where((F.col("url_page_id") == F.col("at.url_page_id")) & (F.col("pos") == F.col("at.pos"))).drop("at")
    return rows.join(dry, "book_id", "left").where(F.col("dry").isNull() | (F.col("url_page_id") < F.col("dry"))).drop("dry")
