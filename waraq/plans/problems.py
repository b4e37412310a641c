"""Queries of the data-quality problems 1 to 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waraq.operators.delivery import keep_one, superfluous
from waraq.operators.nested import NestedRecords, subtype_table
from waraq.operators.orphans import orphan_references, orphan_report, references
from waraq.sources import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references(table(spark, d, "toc"), "toc", "toc_id", "page_id").unionByName(references(table(spark, d, "volumes"), "volumes", "vol_id", "start_page"))
    return orphan_references(refs, table(spark, d, "pages"))


def _nested(spark: SparkSession, d: str) -> NestedRecords:
    return NestedRecords(table(spark, d, "book_meta"))


QUERIES = {
    "p1_found": lambda s, d: _orphans(s, d).select("ref_table", "ref_id", "state"),
    "p1_report": lambda s, d: orphan_report(_orphans(s, d)),
    "p2_found": lambda s, d: superfluous(table(s, d, "pages")),
    "p2_kept": lambda s, d: keep_one(table(s, d, "pages")).select("delivery_id", "book_id", "number", "sub_idx"),
    "p3_found": lambda s, d: _nested(s, d).nodes().select("record_id", "seq", "parent_seq"),
    "p3_records": lambda s, d: _nested(s, d).records(),
    "p3_record_sizes": lambda s, d: _nested(s, d).records().select("record_id", "well_formed", "n_nodes", "max_depth"),
    "p3_nodes": lambda s, d: _nested(s, d).nodes(),
    "p3_variants": lambda s, d: _nested(s, d).variants(),
    "p3_page_int": lambda s, d: subtype_table(_nested(s, d).nodes(), "page_int"),
    "p3_page_text": lambda s, d: subtype_table(_nested(s, d).nodes(), "page_text"),
    "p3_page_object": lambda s, d: subtype_table(_nested(s, d).nodes(), "page_object"),
    "p3_page_none": lambda s, d: subtype_table(_nested(s, d).nodes(), "page_none"),
    "p3_strays": lambda s, d: _nested(s, d).strays(),
    "p3_page_odd": lambda s, d: subtype_table(_nested(s, d).nodes(), "page_odd"),
}

_STATES = """
WITH refs AS (
  SELECT 'toc' AS ref_table, toc_id AS ref_id, book_id, page_id AS number, recorded_at FROM toc WHERE page_id <> 0
  UNION ALL
  SELECT 'volumes', vol_id, book_id, start_page, recorded_at FROM volumes WHERE start_page <> 0
), valid AS (
  SELECT book_id, coalesce(page_id, url_page_id) AS number, min(received_at) AS first_received, bool_or(removed_at IS NOT NULL) AS removed
  FROM pages WHERE coalesce(page_id, url_page_id) IS NOT NULL GROUP BY 1, 2
), states AS (
  SELECT r.ref_table, r.ref_id, r.recorded_at,
    CASE WHEN v.number IS NULL THEN 'missing' WHEN v.removed THEN 'deleted' WHEN v.first_received > r.recorded_at THEN 'late' END AS state
  FROM refs r LEFT JOIN valid v ON r.book_id = v.book_id AND r.number = v.number
)
"""

_RANKED = """
SELECT delivery_id, book_id, coalesce(page_id, url_page_id) AS number, sub_idx,
  row_number() OVER (PARTITION BY book_id, coalesce(page_id, url_page_id), sub_idx ORDER BY received_at NULLS LAST, delivery_id) AS r
FROM pages WHERE coalesce(page_id, url_page_id) IS NOT NULL
"""

# Nodes of every record: the tree of the record down to its outlines, then the tree of each outline down its children.
_NODES = """
WITH RECURSIVE docs AS (SELECT record_id, e.id, e.parent, e.key, e.type, e.value FROM book_meta, json_tree(CASE WHEN json_valid(meta) THEN meta END) e),
reach AS (SELECT record_id, id, key, type, value FROM docs WHERE parent IS NULL
  UNION ALL SELECT d.record_id, d.id, d.key, d.type, d.value FROM docs d JOIN reach r ON r.record_id = d.record_id AND d.parent = r.id WHERE NOT coalesce(r.key = 'toc' AND r.id > 0, false)),
texts AS (SELECT record_id, id AS toc, type, CASE WHEN type = 'VARCHAR' THEN value->>'$' ELSE value::VARCHAR END AS body FROM reach WHERE key = 'toc'),
elements AS (SELECT record_id, toc, e.id, e.parent, e.key, e.type, e.value FROM texts, json_tree(CASE WHEN json_valid(body) THEN body END) e),
nodes AS (SELECT record_id, toc, id, NULL::UBIGINT AS above, 0 AS depth, value FROM elements WHERE parent IS NULL AND type = 'OBJECT'
  UNION ALL SELECT e.record_id, e.toc, e.id, NULL, 0, e.value FROM elements e JOIN elements p ON p.record_id = e.record_id AND p.toc = e.toc AND p.parent IS NULL AND p.type = 'ARRAY' AND e.parent = p.id WHERE e.type = 'OBJECT'
  UNION ALL (SELECT e.record_id, e.toc, e.id, n.id, n.depth + 1, e.value FROM nodes n JOIN elements m ON m.record_id = n.record_id AND m.toc = n.toc AND m.parent = n.id AND m.key = 'children'
    JOIN elements e ON e.record_id = m.record_id AND e.toc = m.toc AND ((m.type = 'OBJECT' AND e.id = m.id) OR (m.type = 'ARRAY' AND e.parent = m.id)) WHERE e.type = 'OBJECT')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY toc, id) - 1 AS seq FROM nodes),
flat AS (SELECT r.record_id, r.seq::INT AS seq, coalesce(p.seq, -1)::INT AS parent_seq, r.depth, r.value->'$.label' AS label_, r.value->'$.page_id' AS page_
  FROM ranked r LEFT JOIN ranked p ON p.record_id = r.record_id AND p.toc = r.toc AND p.id = r.above),
typed AS (SELECT record_id, seq, parent_seq, depth,
  CASE json_type(label_) WHEN 'VARCHAR' THEN label_->>'$' WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN coalesce(if(json_type(label_->'$.text') = 'VARCHAR', label_->>'$.text', NULL), if(json_type(label_->'$.value') = 'VARCHAR', label_->>'$.value', NULL),
    if(json_type(label_->'$.label') = 'VARCHAR', label_->>'$.label', NULL), if(json_type(label_->'$.ar') = 'VARCHAR', label_->>'$.ar', NULL), label_::VARCHAR) ELSE label_::VARCHAR END AS label,
  page_, coalesce(json_type(page_), 'NULL') AS kind, translate(trim(page_->>'$'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS shown FROM flat)
"""
_PAGE = "SELECT record_id, seq, parent_seq, depth, label"
_INTEGER = "kind IN ('UBIGINT', 'BIGINT')"
_DIGITS = "kind = 'VARCHAR' AND regexp_full_match(shown, '-?[0-9]+')"
_object_int = lambda key: f"try_cast(translate(trim(page_->>'$.{key}'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS BIGINT)"

SQL = {
    "p3_found": _NODES + "SELECT record_id, seq, parent_seq FROM flat",
    "p3_page_int": _NODES + f"{_PAGE}, (page_->>'$')::BIGINT AS page_int FROM typed WHERE {_INTEGER}",
    "p3_page_text": _NODES + f"{_PAGE}, page_->>'$' AS page_text, try_cast(shown AS BIGINT) AS page_number FROM typed WHERE {_DIGITS}",
    "p3_page_object": _NODES + f"{_PAGE}, {_object_int('value')} AS page_value, {_object_int('printed')} AS page_printed, page_::VARCHAR AS page_json FROM typed WHERE kind = 'OBJECT'",
    "p3_page_none": _NODES + f"{_PAGE} FROM typed WHERE kind = 'NULL'",
    "p3_page_odd": _NODES + f"{_PAGE}, CASE WHEN kind = 'DOUBLE' AND (page_->>'$')::DOUBLE = floor((page_->>'$')::DOUBLE) THEN (page_->>'$')::DOUBLE::BIGINT END AS page_number, page_::VARCHAR AS page_json FROM typed "
                            f"WHERE kind <> 'NULL' AND kind <> 'OBJECT' AND NOT ({_INTEGER}) AND NOT ({_DIGITS})",
    "p3_record_sizes": _NODES + """, sizes AS (SELECT record_id, count(*) AS n, max(depth) AS d FROM nodes GROUP BY 1)
SELECT b.record_id, coalesce(json_valid(meta), false) AS well_formed, coalesce(n, 0)::INT AS n_nodes, d AS max_depth FROM book_meta b LEFT JOIN sizes USING (record_id)""",
    "p1_found": _STATES + "SELECT ref_table, ref_id, state FROM states WHERE state IS NOT NULL",
    "p1_report": _STATES + "SELECT ref_table, strftime(recorded_at, '%Y-%m') AS month, state, count(*) AS n_refs FROM states WHERE state IS NOT NULL GROUP BY 1, 2, 3",
    "p2_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE r > 1",
    "p2_kept": f"SELECT delivery_id, book_id, number, sub_idx FROM ({_RANKED}) WHERE r = 1",
}
