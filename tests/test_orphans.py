from collections import Counter
from datetime import datetime

from waraq.operators.orphans import orphan_references, orphan_report, references
from waraq.operators.skew import left_lookup

TOC = "toc_id bigint, book_id int, page_id int, recorded_at timestamp, state string, number int"
PAGES = "delivery_id bigint, book_id int, page_id int, url_page_id int, received_at timestamp, removed_at timestamp, found boolean, recorded_at timestamp"
D = lambda day: datetime(2024, 1, day)


def pages(spark, rows):
    return spark.createDataFrame([(k, *r, None, None) for k, r in enumerate(rows)], PAGES)


def toc(spark, rows):
    return spark.createDataFrame([(*r, "clash", 99) for r in rows], TOC)


def states(spark, refs, deliveries):
    out = orphan_references(references(toc(spark, refs), "toc", "toc_id", "page_id"), pages(spark, deliveries))
    return sorted((r.ref_id, r.state) for r in out.collect())


def test_states(spark):
    deliveries = [(1, 5, None, D(3), None), (1, None, 6, D(3), None), (1, 6, 9, D(8), D(9)), (1, 7, 7, D(20), None), (1, 8, 8, None, None)]
    refs = [(1, 1, 5, D(4)), (2, 1, 6, D(4)), (3, 1, 7, D(4)), (4, 1, 99, D(4)), (5, 2, 5, D(4)), (6, 1, 9, D(4)), (7, 1, 8, D(4))]
    assert states(spark, refs, deliveries) == [(2, "deleted"), (3, "late"), (4, "missing"), (5, "missing"), (6, "missing")]


def test_earliest_arrival_counts(spark):
    assert states(spark, [(1, 1, 5, D(4))], [(1, 5, 5, D(9), None), (1, 5, 5, D(2), None)]) == []


def test_no_reference_and_nulls(spark):
    refs = [(1, 1, None, D(1)), (2, 1, 0, D(1)), (3, None, 5, D(1)), (4, 1, 5, None), (None, 1, 77, D(1))]
    got = orphan_references(references(toc(spark, refs), "toc", "toc_id", "page_id"), pages(spark, [(1, 5, 5, D(2), None), (None, 5, 5, D(2), None)])).collect()
    assert sorted((str(r.ref_id), r.state) for r in got) == [("3", "missing"), ("None", "missing")]


def test_empty_tables_and_repeats(spark):
    assert states(spark, [], [(1, 5, 5, D(1), None)]) == []
    assert states(spark, [(1, 1, 5, D(1)), (1, 1, 5, D(1))], []) == [(1, "missing"), (1, "missing")]


def test_hot_page_is_split_and_whole(spark):
    refs = [(k, 1, 5, D(4)) for k in range(4000)] + [(k, 1, k, D(4)) for k in range(4000, 4400)]
    got = Counter(s for _, s in states(spark, refs, [(1, 5, 5, D(9), None)]))
    assert got == {"late": 4000, "missing": 400}


def test_lookup_keeps_every_row_once(spark):
    rows = spark.createDataFrame([(k % 3 if k else None, k) for k in range(3000)], "k int, id int")
    look = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    got = left_lookup(rows, look, ["k"], rows["id"]).collect()
    assert sorted(r.id for r in got) == list(range(3000))
    assert all(r.v == {0: "a", 1: "b"}.get(r.k) for r in got)


def test_report(spark):
    refs = references(toc(spark, [(1, 1, 5, D(4)), (2, 1, 6, D(5)), (3, 1, 6, None)]), "toc", "toc_id", "page_id")
    got = {(r.ref_table, r.month, r.state, r.n_refs) for r in orphan_report(orphan_references(refs, pages(spark, []))).collect()}
    assert got == {("toc", "2024-01", "missing", 2), ("toc", None, "missing", 1)}
