import random

import pytest

from waraq.operators import outline, volumes

TOC = "toc_id bigint, book_id int, seq int, level int, label string, page_id int"


def random_toc(seed, books=3, n=60):
    rng = random.Random(seed)
    rows = []
    for b in range(books):
        level = 0
        for k in range(rng.randrange(n)):
            level = max(0, min(5, level + rng.choice([-2, -1, 0, 0, 1, 1, 2])))
            rows.append((len(rows), b, k, level, rng.choice([None, "", "x", "y ", " z"]) if rng.random() < 0.4 else f"l{k}", rng.choice([None, 0, *range(1, 40)])))
    return rows


def naive_repair(rows):
    out = {}
    for b in {r[1] for r in rows}:
        own = [[i, lv, lab, p or None] for i, bb, _, lv, lab, p in rows if bb == b]
        for k, (i, lv, lab, p) in enumerate(own):
            if lab:
                pages = [p]
                for _, lv2, lab2, p2 in own[k + 1 :]:
                    if lab2:
                        if lv2 <= lv:
                            break
                        pages.append(p2)
                pages = [x for x in pages if x is not None]
                out[i] = min(pages) if pages else None
            else:
                out[i] = p
    return out


def naive_numbers(rows):
    out = {}
    for b in {r[1] for r in rows}:
        counters, stack = [0] * 20, []
        for i, _, _, lv, lab, p in sorted((r for r in rows if r[1] == b and r[5]), key=lambda r: (r[5], r[2])):
            while stack and stack[-1][0] >= lv:
                stack.pop()
            counters[lv] += 1
            counters[lv + 1 :] = [0] * (19 - lv)
            number = ".".join(map(str, counters[: lv + 1]))
            parent = stack[-1][1] if stack else None
            if lab:
                stack.append((lv, number))
            out[i] = (number, parent, stack[-1][1] if stack else None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_and_numbers_equal_the_loops(spark, seed):
    rows = random_toc(seed)
    toc = spark.createDataFrame(rows, TOC)
    assert {r.toc_id: r.page_id for r in outline.repaired(toc).collect()} == naive_repair(rows)
    assert {r.toc_id: (r.number, r.parent_number, r.open_number) for r in outline.numbered(toc).collect()} == naive_numbers(rows)


def numbers(spark, levels):
    toc = spark.createDataFrame([(k, 1, k, lv, "x", 1) for k, lv in enumerate(levels)], TOC)
    return [r.number for r in sorted(outline.numbered(toc).collect(), key=lambda r: r.seq)]


def test_contract_numbers(spark):
    assert numbers(spark, [0, 1, 1, 0, 2]) == ["1", "1.1", "1.2", "2", "2.0.1"]


def test_entries_fall_on_the_next_page(spark):
    toc = spark.createDataFrame([(1, 1, 0, 0, "a", 3), (2, 1, 1, 0, "b", 5), (3, 1, 2, 0, "c", 9)], TOC)
    pages = spark.createDataFrame([(1, 1), (1, 4), (1, 6)], "book_id int, page_id int")
    assert {r.toc_id: r.page for r in outline.on_pages(toc, pages).collect()} == {1: 4, 2: 6, 3: None}
    shown = {r.page_id: (r.toc_number, r.toc_breadcrumb) for r in outline.page_outline(toc, pages).collect()}
    assert shown == {1: ("", ""), 4: ("1", "a"), 6: ("2", "b")}


def test_page_with_several_entries_and_its_followers(spark):
    toc = spark.createDataFrame([(1, 1, 0, 0, "a", 1), (2, 1, 1, 1, "b", 1), (3, 1, 2, 0, None, 2)], TOC)
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "book_id int, page_id int")
    shown = {(r.book_id, r.page_id): (r.toc_number, r.toc_breadcrumb) for r in outline.page_outline(toc, pages).collect()}
    assert shown == {(1, 1): ("1-1.1", "a • b"), (1, 2): ("", ""), (2, 1): ("", "")}


def test_summary_of_empty_books(spark):
    toc = spark.createDataFrame([(1, 1, 0, 0, "a", 1), (2, 1, 1, 3, "b", 1)], TOC)
    books = spark.createDataFrame([(1,), (2,)], "book_id int")
    assert {r.book_id: tuple(r)[1:] for r in outline.summary(toc, books).collect()} == {1: (2, 1, 4), 2: (0, 0, 0)}


def naive_volume_numbers(rows, prefix):
    out, state = {}, {}
    for i, b, v, _, _, level, auto in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4])):
        if v < 0:
            out[i] = None
            continue
        c, base = state.get((b, v), ([0] * 20, None))
        base = level if base is None else min(base, level)
        lv = level - base
        if prefix and lv > 1:
            out[i] = ""
        else:
            if auto:
                parts = [max(x, 1) for x in c[:lv]] + [c[lv] + 1]
            else:
                for k in range(lv):
                    if c[k] == 0:
                        c[k] = 1
                        c[k + 1 : lv + 1] = [0] * (lv - k)
                c[lv] += 1
                c[lv + 1 :] = [0] * (19 - lv)
                parts = c[: lv + 1]
            out[i] = ".".join(map(str, [v + 1, *parts] if prefix else parts))
        state[b, v] = c, base
    return out


@pytest.mark.parametrize("prefix", [False, True])
def test_volume_numbers_equal_the_loop(spark, prefix):
    rng = random.Random(4)
    rows = [(k, rng.choice([1, 2]), rng.choice([-1, 0, 1]), rng.randrange(900), k, rng.randrange(4), rng.random() < 0.25) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, book_id int, volume int, page_id int, ord int, level int, auto boolean")
    assert {r.id: r.volume_number for r in volumes.volume_numbers(df, prefix, 5).collect()} == naive_volume_numbers(rows, prefix)


def test_contract_volume_numbers_and_merge(spark):
    df = spark.createDataFrame([(k, 1, 0, 1, k, lv, False) for k, lv in enumerate([1, 0, 1])], "id int, book_id int, volume int, page_id int, ord int, level int, auto boolean")
    assert [r.volume_number for r in sorted(volumes.volume_numbers(df, False).collect(), key=lambda r: r.id)] == ["1", "2", "2.1"]
    vol = spark.createDataFrame([(1, 0, 1, "م 1"), (1, 1, 5, "1"), (1, 2, 9, "م 2"), (1, 3, 12, "٢"), (1, 4, 12, "again"), (2, 0, 1, None)], "book_id int, ord int, start_page int, label string")
    got = sorted(map(tuple, volumes.merged(volumes.bounds(vol)).collect()))
    assert got == [(1, 0, 1, 8, "1"), (1, 1, 9, None, "٢"), (2, 0, 1, None, None)]
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 8), (1, 9), (1, 99), (3, 1), (1, None)], "book_id int, page_id int")
    assert {(r.book_id, r.page_id): r.volume for r in volumes.volume_of(pages, volumes.bounds(vol)).collect()} == {(1, 0): -1, (1, 1): 0, (1, 8): 1, (1, 9): 2, (1, 99): 3, (3, 1): -1, (1, None): None}


def test_empty_outline(spark):
    toc = spark.createDataFrame([], TOC)
    assert outline.numbered(outline.repaired(toc)).collect() == []
    assert outline.page_outline(toc, spark.createDataFrame([(1, 1)], "book_id int, page_id int")).collect()[0].toc_number == ""


def test_deep_levels_are_numbered_and_rows_without_a_level_keep_their_place(spark):
    toc = spark.createDataFrame([(0, 1, 0, 0, "a", 1), (1, 1, 1, 25, "deep", 1), (2, 1, 2, None, "none", 1), (3, 1, 3, 1, "b", 1), (4, 1, 4, -1, "below", 1)], TOC)
    deep = ".".join(["1", *["0"] * 24, "1"])
    assert {r.toc_id: r.number for r in outline.numbered(toc).collect()} == {0: "1", 1: deep, 2: None, 3: "1.1", 4: None}
    pages = spark.createDataFrame([(1, 1)], "book_id int, page_id int")
    assert outline.page_outline(toc, pages).first().toc_breadcrumb == "a • deep • b"
