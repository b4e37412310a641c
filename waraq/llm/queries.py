"""Queries of the problems on text."""

from __future__ import annotations

from waraq.llm.lookalike import LookAlikes
from waraq.llm.mixing import Mixture
from waraq.llm.packing import Packing, summary
from waraq.llm.spans import SharedSpans
from waraq.llm.subjects import SubjectModel
from waraq.sources import table


def _packing(spark, d) -> Packing:
    return Packing(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def _mixture(spark, d) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _beyond(spark, d) -> Mixture:
    """A mixture of twice the budget at which every source delivers its share: sources run out at their limits, and the shares show it."""
    whole = _mixture(spark, d)
    whole.budget *= 2
    return whole


def _subjects(spark, d) -> SubjectModel:
    return SubjectModel(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


QUERIES = {
    "p4_found": lambda s, d: SharedSpans(table(s, d, "page_lines")).pairs(),
    "p4_shared": lambda s, d: SharedSpans(table(s, d, "page_lines")).shared(),
    "p4_links": lambda s, d: SharedSpans(table(s, d, "page_lines")).links(),
    "p5_found": lambda s, d: LookAlikes(table(s, d, "toc"), table(s, d, "page_lines")).pairs(),
    "p5_forms": lambda s, d: LookAlikes(table(s, d, "toc"), table(s, d, "page_lines")).forms(),
    "p6_sequences": lambda s, d: _packing(s, d).sequences(),
    "p6_fill": lambda s, d: _packing(s, d).fill(),
    "p6_summary": lambda s, d: summary(_packing(s, d).fill()),
    "p7_mix": lambda s, d: _mixture(s, d).documents(),
    "p7_shares_beyond": lambda s, d: _beyond(s, d).shares(),
    "p7_shares": lambda s, d: _mixture(s, d).shares(),
    "p8_found": lambda s, d: _subjects(s, d).found(),
    "p8_posteriors": lambda s, d: _subjects(s, d).all_posteriors(),
    "p8_agreement": lambda s, d: _subjects(s, d).agreement(),
    "p8_composition": lambda s, d: _subjects(s, d).composition(),
}

_WINDOWS = """WITH windows AS (SELECT line_id, i, substring(html, i, 120) AS s FROM (SELECT line_id, html, unnest(range(1, length(html) - 118)) AS i FROM page_lines WHERE length(html) >= 120)),
met AS (SELECT s FROM windows GROUP BY s HAVING min(line_id) <> max(line_id)),
own AS (SELECT line_id, i, s FROM windows WHERE s IN (SELECT s FROM met))
"""

SQL = {
    "p4_found": _WINDOWS + ", each AS (SELECT DISTINCT line_id, s FROM own) SELECT DISTINCT a.line_id AS line_a, b.line_id AS line_b FROM each a JOIN each b ON a.s = b.s AND a.line_id < b.line_id",
    "p4_shared": _WINDOWS + """, stretches AS (SELECT line_id, least(120, i - lag(i, 1, -120) OVER (PARTITION BY line_id ORDER BY i)) AS n FROM own)
SELECT l.line_id, coalesce(length(l.html), 0)::INT AS n_chars, coalesce(sum(n), 0)::BIGINT AS shared_chars FROM page_lines l LEFT JOIN stretches s ON s.line_id = l.line_id GROUP BY l.line_id, l.html""",
}
