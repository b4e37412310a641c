"""Queries of outlines, pages and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.operators import outline, volumes
from waraq.plans import sqltext as q
from waraq.sources import table


def _toc(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "toc").select("toc_id", "book_id", "seq", "level", "label", "page_id")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_lines").select("book_id", "page_id").distinct()


def _bounds(s: SparkSession, d: str) -> DataFrame:
    return volumes.bounds(table(s, d, "volumes"))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return outline.numbered(outline.repaired(_toc(s, d)))


def _headings(s: SparkSession, d: str) -> DataFrame:
    """Outline entries as headings of their volume; every seventh stands in for an automatic one."""
    rows = _numbered(s, d).select("toc_id", "book_id", "page_id", F.col("seq").alias("ord"), "level", (F.col("toc_id") % 7 == 0).alias("auto"))
    return volumes.volume_of(rows, volumes.merged(_bounds(s, d)))


QUERIES = {
    "toc_summary": lambda s, d: outline.summary(_toc(s, d), table(s, d, "books")),
    "toc_repaired": lambda s, d: outline.repaired(_toc(s, d)).select("toc_id", "page_id"),
    "outline_numbers": lambda s, d: _numbered(s, d).select("toc_id", "number"),
    "outline_parents": lambda s, d: _numbered(s, d).select("toc_id", "parent_number"),
    "toc_to_page": lambda s, d: outline.on_pages(_numbered(s, d), _pages(s, d)).select("toc_id", "page"),
    "page_outline": lambda s, d: outline.page_outline(_toc(s, d), _pages(s, d)),
    "sibling_inversion": lambda s, d: outline.inversions(_numbered(s, d).select("book_id", F.col("seq").alias("page_id"), F.col("toc_id").alias("ord"), "number")),
    "bare_outlines": lambda s, d: outline.bare(_toc(s, d)),
    "max_levels": lambda s, d: _toc(s, d).groupBy("book_id").agg(F.max("level").alias("max_level")),
    "heading_parents": lambda s, d: outline.with_parents(_numbered(s, d)).select("toc_id", "parent_label", "n_children"),
    "book_documents": lambda s, d: outline.book_documents(table(s, d, "books"), _toc(s, d)),
    "skipped_in_outline": lambda s, d: volumes.skipped_in_outline(volumes.volume_of(
        _numbered(s, d).select("toc_id", "book_id", "page_id", F.col("seq").alias("ord"), F.element_at(F.split("label", " "), 1).alias("text"), (F.col("level") == 0).alias("auto"), (F.col("level") > 0).alias("implicit")), _bounds(s, d))).select("toc_id"),
    "volume_bounds": lambda s, d: _bounds(s, d),
    "volume_merge": lambda s, d: volumes.merged(_bounds(s, d)),
    "volume_suffix": lambda s, d: _bounds(s, d).select("book_id", "volume", volumes.suffix(F.col("label"), F.col("volume")).alias("suffix")),
    "page_volume": lambda s, d: volumes.volume_of(_pages(s, d), _bounds(s, d)).select("book_id", "page_id", F.col("volume").cast("int").alias("volume")),
    "volume_pages": lambda s, d: volumes.volume_of(_pages(s, d), _bounds(s, d)).where("volume >= 0").groupBy("book_id", F.col("volume").cast("int").alias("volume")).agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")),
    "running_min_level": lambda s, d: outline.running(_numbered(s, d), ["book_id"], outline.bucket_of(F.col("seq")), [F.col("seq")], least={"min_level": F.col("level")}).select("toc_id", "min_level"),
    "volume_numbers": lambda s, d: volumes.volume_numbers(_headings(s, d), False, outline.depth(_toc(s, d))).select("toc_id", "level_in_volume", "volume_number"),
    "volume_numbers_prefixed": lambda s, d: volumes.volume_numbers(_headings(s, d), True, outline.depth(_toc(s, d))).select("toc_id", "level_in_volume", "volume_number"),
}

_REPAIRED = """
t AS (SELECT toc_id, book_id, seq, level, label, nullif(page_id, 0) AS page_id, coalesce(label, '') <> '' AS named FROM toc),
ends AS (SELECT a.toc_id, a.book_id, a.seq, min(b.seq) AS past FROM t a LEFT JOIN t b ON a.book_id = b.book_id AND b.named AND b.seq > a.seq AND b.level <= a.level WHERE a.named GROUP BY ALL),
least AS (SELECT e.toc_id, min(b.page_id) AS page_id FROM ends e JOIN t b ON e.book_id = b.book_id AND b.named AND b.seq >= e.seq AND (e.past IS NULL OR b.seq < e.past) GROUP BY ALL),
repaired AS (SELECT t.toc_id, t.book_id, t.seq, t.level, t.label, t.named, CASE WHEN t.named THEN l.page_id ELSE t.page_id END AS page_id FROM t LEFT JOIN least l USING (toc_id))
"""
_NUMBERED = _REPAIRED + """,
o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_id, seq) AS n FROM repaired WHERE page_id IS NOT NULL),
resets AS (SELECT a.toc_id, a.book_id, a.n, a.level, i.i, coalesce(max(b.n) FILTER (b.level < i.i), 0) AS since
  FROM o a JOIN (SELECT unnest(range(0, 20)) AS i) i ON i.i <= a.level LEFT JOIN o b ON a.book_id = b.book_id AND b.n <= a.n GROUP BY ALL),
counts AS (SELECT r.toc_id, r.i, count(b.n) AS c FROM resets r LEFT JOIN o b ON r.book_id = b.book_id AND b.n <= r.n AND b.n > r.since AND b.level = r.i GROUP BY ALL),
numbers AS (SELECT toc_id, string_agg(c::VARCHAR, '.' ORDER BY i) AS number FROM counts GROUP BY toc_id),
open_above AS (SELECT a.toc_id, max(b.n) AS p FROM o a JOIN o b ON a.book_id = b.book_id AND b.n < a.n AND b.level < a.level AND b.named
  WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.book_id = a.book_id AND c.n > b.n AND c.n < a.n AND c.level <= b.level) GROUP BY ALL),
numbered AS (SELECT o.*, x.number, y.number AS parent_number, p.label AS parent_label FROM o JOIN numbers x USING (toc_id) LEFT JOIN open_above u USING (toc_id)
  LEFT JOIN o p ON p.book_id = o.book_id AND p.n = u.p LEFT JOIN numbers y ON y.toc_id = p.toc_id)
"""
_BOUNDS = """
starts AS (SELECT book_id, start_page, label, row_number() OVER (PARTITION BY book_id, start_page ORDER BY ord) AS r FROM volumes WHERE start_page IS NOT NULL),
bounds AS (SELECT book_id, row_number() OVER w - 1 AS volume, start_page, lead(start_page) OVER w - 1 AS last_page, label FROM starts WHERE r = 1 WINDOW w AS (PARTITION BY book_id ORDER BY start_page))
"""
_MERGED = _BOUNDS + """,
flagged AS (SELECT *, coalesce(regexp_matches(trim(label), '^[0-9٠-٩]+$'), false) AS numeric FROM bounds),
beside AS (SELECT *, lead(numeric) OVER w AS next, lag(numeric) OVER w AS before, lead(label) OVER w AS next_label FROM flagged WINDOW w AS (PARTITION BY book_id ORDER BY volume)),
merged AS (SELECT book_id, row_number() OVER w - 1 AS volume, start_page, lead(start_page) OVER w - 1 AS last_page, CASE WHEN NOT numeric AND next THEN next_label ELSE label END AS label
  FROM beside WHERE NOT (numeric AND coalesce(NOT before, false)) WINDOW w AS (PARTITION BY book_id ORDER BY volume))
"""
_PAGES = "known AS (SELECT DISTINCT book_id, page_id FROM page_lines)"


def _volume_numbers(prefix: bool) -> str:
    takes = "(NOT auto AND lv <= 1)" if prefix else "(NOT auto)"
    number = "CASE WHEN v.volume < 0 THEN NULL " + ("WHEN v.lv > 1 THEN '' ELSE (v.volume + 1)::VARCHAR || '.' || s.number END" if prefix else "ELSE s.number END")
    return f"""
WITH {_NUMBERED}, {_MERGED},
heads AS (SELECT n.toc_id, n.book_id, n.page_id, n.seq, n.level, n.toc_id % 7 = 0 AS auto, coalesce(max(b.volume), -1) AS volume
  FROM numbered n LEFT JOIN merged b ON b.book_id = n.book_id AND b.start_page <= n.page_id GROUP BY ALL),
based AS (SELECT *, greatest(level - min(level) OVER w, 0) AS lv, row_number() OVER w AS n2 FROM heads WINDOW w AS (PARTITION BY book_id, volume ORDER BY page_id, seq)),
v AS (SELECT *, {takes} AS takes FROM based),
prior AS (SELECT a.toc_id, arg_max(b.lv, b.n2) AS prev FROM v a LEFT JOIN v b ON a.book_id = b.book_id AND a.volume = b.volume AND b.takes AND b.n2 < a.n2 GROUP BY ALL),
w AS (SELECT v.*, coalesce(p.prev, -1) AS prev FROM v JOIN prior p USING (toc_id)),
since AS (SELECT a.toc_id, a.book_id, a.volume, a.n2, a.lv, a.auto, i.i, coalesce(max(b.n2) FILTER (b.takes AND b.lv < i.i), 0) AS since
  FROM w a JOIN (SELECT unnest(range(0, 20)) AS i) i ON i.i <= a.lv LEFT JOIN w b ON a.book_id = b.book_id AND a.volume = b.volume AND b.n2 <= a.n2 GROUP BY ALL),
counted AS (SELECT s.toc_id, s.i, s.lv, s.auto, count(b.n2) AS c FROM since s LEFT JOIN w b ON s.book_id = b.book_id AND s.volume = b.volume AND b.takes AND b.n2 <= s.n2 AND b.n2 > s.since
  AND (b.lv = s.i OR (b.lv > s.i AND b.prev < s.i)) GROUP BY ALL),
s AS (SELECT toc_id, string_agg((CASE WHEN auto AND i = lv THEN c + 1 WHEN auto THEN greatest(c, 1) ELSE c END)::VARCHAR, '.' ORDER BY i) AS number FROM counted GROUP BY toc_id)
SELECT v.toc_id, CASE WHEN v.volume >= 0 THEN v.lv END::INT AS level_in_volume, {number} AS volume_number FROM v JOIN s USING (toc_id)"""


SQL = {
    "toc_summary": "SELECT b.book_id, count(t.toc_id) AS total_entries, count(t.toc_id) FILTER (t.level = 0) AS top_level_entries, coalesce(max(t.level) + 1, 0)::INT AS max_depth "
                   "FROM (SELECT DISTINCT book_id FROM books) b LEFT JOIN toc t ON b.book_id = t.book_id GROUP BY 1",
    "toc_repaired": f"WITH {_REPAIRED} SELECT toc_id, page_id FROM repaired",
    "outline_numbers": f"WITH {_NUMBERED} SELECT toc_id, number FROM numbered",
    "outline_parents": f"WITH {_NUMBERED} SELECT toc_id, parent_number FROM numbered",
    "toc_to_page": f"WITH {_NUMBERED}, {_PAGES} SELECT n.toc_id, min(k.page_id) AS page FROM numbered n LEFT JOIN known k ON k.book_id = n.book_id AND k.page_id >= n.page_id GROUP BY 1",
    "page_outline": f"""WITH {_NUMBERED}, {_PAGES},
placed AS (SELECT n.*, (SELECT min(k.page_id) FROM known k WHERE k.book_id = n.book_id AND k.page_id >= n.page_id) AS page FROM numbered n),
here AS (SELECT book_id, page, string_agg({q.bare('label')}, ' • ' ORDER BY n) AS labels, arg_min(number, n) AS first, arg_max(number, n) AS last, count(*) AS c FROM placed WHERE named AND page IS NOT NULL GROUP BY ALL),
latest AS (SELECT k.book_id, k.page_id, max(n.n) AS n FROM known k JOIN numbered n ON n.book_id = k.book_id AND n.page_id <= k.page_id GROUP BY ALL)
SELECT k.book_id, k.page_id, CASE WHEN h.c > 1 THEN h.first || '-' || h.last WHEN h.c = 1 THEN h.first ELSE coalesce(CASE WHEN m.named THEN m.number ELSE m.parent_number END, '') END AS toc_number,
  coalesce(h.labels, {q.bare('CASE WHEN m.named THEN m.label ELSE m.parent_label END')}, '') AS toc_breadcrumb
FROM known k LEFT JOIN here h ON h.book_id = k.book_id AND h.page = k.page_id LEFT JOIN latest l ON l.book_id = k.book_id AND l.page_id = k.page_id
LEFT JOIN numbered m ON m.book_id = l.book_id AND m.n = l.n""",
    "sibling_inversion": f"""WITH {_NUMBERED}, p AS (SELECT book_id, [x::INT for x in string_split(number, '.')] AS v, lag([x::INT for x in string_split(number, '.')]) OVER (PARTITION BY book_id ORDER BY seq, toc_id) AS before FROM numbered)
SELECT book_id, count(*) AS n_inversions FROM p WHERE v < before GROUP BY 1""",
    "bare_outlines": f"""SELECT book_id, count(*) AS n_entries, count(*) FILTER ({q.is_digits('label')}) AS n_bare,
  count(*) FILTER ({q.is_digits('label')}) >= 0.8 * count(*) AS is_bare FROM toc GROUP BY 1""",
    "max_levels": "SELECT book_id, max(level) AS max_level FROM toc GROUP BY 1",
    "heading_parents": f"WITH {_NUMBERED} SELECT n.toc_id, n.parent_label, (SELECT count(*) FROM numbered c WHERE c.book_id = n.book_id AND c.parent_number = n.number) AS n_children FROM numbered n",
    "skipped_in_outline": f"""WITH {_NUMBERED}, {_BOUNDS}, h AS (SELECT n.toc_id, n.book_id, n.page_id, n.seq, split_part(n.label, ' ', 1) AS label, n.level, coalesce(max(b.volume), -1) AS volume FROM numbered n LEFT JOIN bounds b ON b.book_id = n.book_id AND b.start_page <= n.page_id GROUP BY ALL)
SELECT toc_id FROM h WHERE level > 0 AND EXISTS (SELECT 1 FROM h a WHERE a.level = 0 AND a.book_id = h.book_id AND a.volume = h.volume AND a.label = h.label AND (a.page_id, a.seq) < (h.page_id, h.seq))""",
    "volume_bounds": f"WITH {_BOUNDS} SELECT book_id, volume::INT AS volume, start_page, last_page::INT AS last_page, label FROM bounds",
    "volume_merge": f"WITH {_MERGED} SELECT book_id, volume::INT AS volume, start_page, last_page::INT AS last_page, label FROM merged",
    "volume_suffix": f"WITH {_BOUNDS} SELECT book_id, volume::INT AS volume, coalesce(nullif(replace(trim(label), ' ', '_'), ''), lpad((volume + 1)::VARCHAR, 2, '0')) AS suffix FROM bounds",
    "page_volume": f"WITH {_BOUNDS}, {_PAGES} SELECT k.book_id, k.page_id, coalesce(max(b.volume), -1)::INT AS volume FROM known k LEFT JOIN bounds b ON b.book_id = k.book_id AND b.start_page <= k.page_id GROUP BY 1, 2",
    "volume_pages": f"WITH {_BOUNDS}, {_PAGES} SELECT b.book_id, b.volume::INT AS volume, count(*) AS n_pages, min(k.page_id) AS first_page, max(k.page_id) AS last_page "
                    "FROM bounds b JOIN known k ON k.book_id = b.book_id AND k.page_id >= b.start_page AND (b.last_page IS NULL OR k.page_id <= b.last_page) GROUP BY 1, 2",
    "running_min_level": f"WITH {_NUMBERED} SELECT toc_id, min(level) OVER (PARTITION BY book_id ORDER BY seq) AS min_level FROM numbered",
    "volume_numbers": _volume_numbers(False),
    "volume_numbers_prefixed": _volume_numbers(True),
}
