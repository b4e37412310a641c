"""Queries of queues, page lists, lookups and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.operators import catalog, renumber, volumes
from waraq.operators.asof import asof
from waraq.plans import sqltext as q
from waraq.sources import table
from waraq.streaming.ingest import landed


def _known(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_lines").select("book_id", "page_id").distinct()


def _queue(s: SparkSession, d: str) -> DataFrame:
    books = table(s, d, "books").where("category_id IS NOT NULL").select("book_id", F.col("category_name").alias("category_label"))
    listed = table(s, d, "documents").select("book_id")
    return catalog.queue([books, listed])


def _nearest(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.lit(0).alias("book_id"), F.col("p_brand").alias("norm"), F.col("p_size").alias("page_id"), F.lit(0).alias("sub_idx"), F.col("p_partkey").alias("ord"))
    return renumber.nearest(rows, rows).select(F.col("ord").alias("p_partkey"), F.col("implicit_page").alias("nearest_size"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def _asof_events(s: SparkSession, d: str, forward: bool) -> DataFrame:
    e = _events(s, d)
    hour = 3_600_000_000
    return asof(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("p")), ["user_id"], "at", "p", "p", "purchase_at", forward, bucket=24 * hour).select("event_id", "purchase_at")


QUERIES = {
    "queue_union": _queue,
    "anti_done": lambda s, d: table(s, d, "books").select("book_id").join(table(s, d, "toc").select("book_id"), "book_id", "left_anti"),
    "status_counts": lambda s, d: catalog.status_counts(table(s, d, "documents"), "lang"),
    "run_tally": lambda s, d: catalog.tally(table(s, d, "orders"), "o_orderstatus", ["F"]),
    "category_labels": lambda s, d: table(s, d, "books").where("author_id IS NOT NULL").groupBy("author_id").agg(F.array_join(F.array_sort(F.collect_set("category_name")), "|").alias("labels")),
    "author_lookup": lambda s, d: catalog.with_lookup(table(s, d, "books").select("book_id", "author_id"), table(s, d, "books").where("author_id IS NOT NULL AND author_url IS NOT NULL").select("author_id", F.col("author_url").alias("known_url")), ["author_id"]).select("book_id", "known_url"),
    "limited_pages": lambda s, d: catalog.first_n(_known(s, d), ["book_id"], ["page_id"], 5),
    "queue_head": lambda s, d: _queue(s, d).select("book_id", "source").orderBy("source", "book_id").limit(20),
    "book_dirs": lambda s, d: table(s, d, "books").select("book_id", catalog.directory(F.col("category_name"), F.col("author"), F.col("title")).alias("dir")),
    "first_wins_dedup": lambda s, d: volumes.first_wins(table(s, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "doc_id"), ["key"], ["doc_id"]).select("doc_id"),
    "first_page": lambda s, d: catalog.first_page(table(s, d, "books"), table(s, d, "toc"), table(s, d, "volumes")),
    "gap_fill": lambda s, d: catalog.page_ids(table(s, d, "toc"), _known(s, d)),
    "fetched_pages": lambda s, d: catalog.page_ids(table(s, d, "toc"), _known(s, d)).select("book_id", "page_id").distinct().join(_known(s, d).withColumn("at_hand", F.lit(True)), ["book_id", "page_id"], "left").na.fill(False, ["at_hand"]),
    "first_deliveries": lambda s, d: volumes.first_wins(table(s, d, "pages").where("url_page_id IS NOT NULL").select("book_id", "url_page_id", "sub_idx", "delivery_id"), ["book_id", "url_page_id"], ["sub_idx", "delivery_id"]).select("book_id", "url_page_id", "delivery_id"),
    "last_page": lambda s, d: _known(s, d).groupBy("book_id").agg(F.max("page_id").alias("last_page")),
    "next_pointer": lambda s, d: catalog.next_pages(_known(s, d)),
    "page_chain": lambda s, d: catalog.chain(catalog.next_pages(_known(s, d)), _known(s, d).groupBy("book_id").agg(F.min("page_id").alias("page_id"))),
    "resume_points": lambda s, d: catalog.resume_points(catalog.page_ids(table(s, d, "toc"), _known(s, d)), _known(s, d)),
    "page_chain_to_stop": lambda s, d: catalog.chain(catalog.next_pages(_known(s, d)), _known(s, d).groupBy("book_id").agg(F.min("page_id").alias("page_id")), table(s, d, "volumes").where("ord = 1").select("book_id", F.col("start_page").alias("stop_id"))),
    "ingest_status": lambda s, d: catalog.ingest_status(catalog.page_ids(table(s, d, "toc"), _known(s, d)), _known(s, d)),
    "nearest_match": _nearest,
    "asof_forward": lambda s, d: _asof_events(s, d, True),
    "asof_backward": lambda s, d: _asof_events(s, d, False),
    "ingest_resume": landed,
}

_KNOWN = "known AS (SELECT DISTINCT book_id, page_id FROM page_lines)"
_QUEUE = """queued AS (SELECT book_id, min(source) AS source, arg_min(label, source) AS category_label FROM (
  SELECT book_id, 0 AS source, coalesce(category_name, '') AS label FROM books WHERE category_id IS NOT NULL UNION ALL SELECT book_id, 1, NULL FROM documents WHERE book_id IS NOT NULL) GROUP BY 1)"""
_PAGE_IDS = _KNOWN + """,
anchors AS (SELECT DISTINCT book_id, page_id FROM toc WHERE page_id <> 0),
spans AS (SELECT a.book_id, min(a.page_id) AS lo, max(a.page_id) AS hi, any_value(k.last) AS last FROM anchors a LEFT JOIN (SELECT book_id, max(page_id) AS last FROM known GROUP BY 1) k ON a.book_id = k.book_id GROUP BY 1 HAVING count(*) >= 2),
nexts AS (SELECT book_id, page_id, lead(page_id) OVER (PARTITION BY book_id ORDER BY page_id) AS next FROM anchors WHERE book_id IN (SELECT book_id FROM spans)),
ids AS (
SELECT book_id, page_id, 'anchor' AS origin FROM nexts WHERE page_id >= 1
UNION ALL SELECT book_id, unnest(range(page_id + 1, next)), 'gap' FROM nexts WHERE next - page_id - 1 BETWEEN 1 AND 20
UNION ALL SELECT book_id, unnest(range(1, lo)), 'before' FROM spans WHERE lo > 1
UNION ALL SELECT book_id, unnest(range(hi + 1, coalesce(last, hi + 100) + 1)), 'tail' FROM spans WHERE coalesce(last, hi + 100) > hi
UNION ALL SELECT k.book_id, k.page_id, 'walked' FROM known k JOIN nexts n ON k.book_id = n.book_id AND k.page_id > n.page_id AND k.page_id < n.next AND n.next - n.page_id - 1 > 20
UNION ALL SELECT book_id, page_id, 'walked' FROM known WHERE book_id NOT IN (SELECT book_id FROM spans))"""

SQL = {
    "queue_union": f"WITH {_QUEUE} SELECT book_id, source, CASE WHEN source = 0 THEN nullif(category_label, '') END AS category_label FROM queued",
    "anti_done": "SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM toc WHERE book_id IS NOT NULL)",
    "status_counts": "SELECT coalesce(lang, '?') AS status, count(*) AS n FROM documents GROUP BY 1",
    "run_tally": "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS n_open FROM orders",
    "category_labels": "SELECT author_id, coalesce(array_to_string(list_sort(list(DISTINCT category_name) FILTER (category_name IS NOT NULL)), '|'), '') AS labels FROM books WHERE author_id IS NOT NULL GROUP BY 1",
    "author_lookup": "SELECT b.book_id, a.known_url FROM books b LEFT JOIN (SELECT author_id, min(author_url) AS known_url FROM books WHERE author_id IS NOT NULL AND author_url IS NOT NULL GROUP BY 1) a ON a.author_id = b.author_id",
    "limited_pages": f"WITH {_KNOWN} SELECT book_id, page_id FROM known QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY page_id) <= 5",
    "queue_head": f"WITH {_QUEUE} SELECT book_id, source FROM queued ORDER BY source, book_id LIMIT 20",
    "book_dirs": f"SELECT book_id, {q.safe_name('category_name')} || '/' || {q.safe_name('author')} || '/' || {q.safe_name('title')} AS dir FROM books",
    "first_wins_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "first_page": "SELECT b.book_id, least(1, v.v, t.t) AS first_page FROM (SELECT DISTINCT book_id FROM books) b LEFT JOIN (SELECT book_id, min(start_page) AS v FROM volumes GROUP BY 1) v ON v.book_id = b.book_id "
                  "LEFT JOIN (SELECT book_id, min(page_id) AS t FROM toc WHERE page_id <> 0 GROUP BY 1) t ON t.book_id = b.book_id",
    "gap_fill": f"WITH {_PAGE_IDS} SELECT book_id, page_id::INT AS page_id, origin FROM ids",
    "fetched_pages": f"WITH {_PAGE_IDS} SELECT DISTINCT i.book_id, i.page_id::INT AS page_id, k.page_id IS NOT NULL AS at_hand FROM ids i LEFT JOIN known k ON k.book_id = i.book_id AND k.page_id = i.page_id",
    "first_deliveries": "SELECT book_id, url_page_id, arg_min(delivery_id, (sub_idx, delivery_id)) AS delivery_id FROM pages WHERE url_page_id IS NOT NULL GROUP BY 1, 2",
    "last_page": f"WITH {_KNOWN} SELECT book_id, max(page_id) AS last_page FROM known GROUP BY 1",
    "next_pointer": f"WITH {_KNOWN} SELECT book_id, page_id, lead(page_id) OVER (PARTITION BY book_id ORDER BY page_id) AS next_id FROM known",
    "page_chain": f"WITH {_KNOWN} SELECT book_id, page_id, row_number() OVER (PARTITION BY book_id ORDER BY page_id) - 1 AS step FROM known",
    "page_chain_to_stop": f"WITH {_KNOWN}, stops AS (SELECT v.book_id, min(v.start_page) AS stop FROM volumes v JOIN known k ON k.book_id = v.book_id AND k.page_id = v.start_page WHERE v.ord = 1 GROUP BY 1) "
                          "SELECT k.book_id, k.page_id, row_number() OVER (PARTITION BY k.book_id ORDER BY k.page_id) - 1 AS step FROM known k LEFT JOIN stops s ON s.book_id = k.book_id WHERE s.stop IS NULL OR k.page_id < s.stop",
    "ingest_status": f"""WITH {_PAGE_IDS}, e AS (SELECT book_id, max(page_id) AS last FROM ids GROUP BY 1), k AS (SELECT book_id, count(*) AS n, max(page_id) AS m FROM known GROUP BY 1)
SELECT e.book_id, CASE WHEN k.m >= e.last THEN 'done' ELSE 'in_progress' END AS status, coalesce(k.m + 1, 1)::INT AS next_page_id, e.last::INT AS last_page_id, coalesce(k.n, 0) AS pages_scraped, NULL::VARCHAR AS error FROM e LEFT JOIN k ON k.book_id = e.book_id""",
    "resume_points": f"""WITH {_PAGE_IDS}, expected AS (SELECT DISTINCT book_id, page_id FROM ids),
holes AS (SELECT e.book_id, min(e.page_id) FILTER (k.page_id IS NULL) AS hole FROM expected e LEFT JOIN known k ON e.book_id = k.book_id AND e.page_id = k.page_id GROUP BY 1),
runs AS (SELECT e.book_id, max(e.page_id) FILTER (h.hole IS NULL OR e.page_id < h.hole) AS flushed_through FROM expected e JOIN holes h ON e.book_id = h.book_id GROUP BY 1)
SELECT r.book_id, coalesce(k.n, 0) AS n_received, k.last AS last_received, r.flushed_through::INT AS flushed_through, coalesce(k.last + 1, 1)::INT AS next_page_id
FROM runs r LEFT JOIN (SELECT book_id, count(*) AS n, max(page_id) AS last FROM known GROUP BY 1) k ON k.book_id = r.book_id""",
    "nearest_match": "SELECT a.p_partkey, arg_min(b.p_size, abs(b.p_size - a.p_size)::BIGINT * 1000000 + b.p_size) AS nearest_size FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size <> b.p_size GROUP BY 1",
    "asof_forward": "WITH e AS (SELECT *, epoch_us(ts) AS at FROM events) SELECT c.event_id, min(p.at) AS purchase_at FROM e c LEFT JOIN e p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.at >= c.at WHERE c.event_type = 'click' GROUP BY 1",
    "asof_backward": "WITH e AS (SELECT *, epoch_us(ts) AS at FROM events) SELECT c.event_id, max(p.at) AS purchase_at FROM e c LEFT JOIN e p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.at <= c.at WHERE c.event_type = 'click' GROUP BY 1",
    "ingest_resume": "SELECT DISTINCT book_id, coalesce(page_id, url_page_id) AS number, sub_idx FROM pages WHERE coalesce(page_id, url_page_id) IS NOT NULL",
}
