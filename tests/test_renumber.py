"""Numbers of renumbered books, against a statement of them that walks the headings of a book one by one."""

import random

import pytest

from waraq.operators import anchor, renumber

PLAIN = {"raw_line": None, "before_child_slot": None, "matched": True, "keep_line": False, "before_child": False, "at_page_top": False, "suppress": []}


def heading(book, page, sub, k, li, **own):
    return PLAIN | {"book_id": book, "page_id": page, "sub_idx": sub, "ord": k, "positions": [{"pi": 0, "li": li}], "auto": False, "implicit": False, "bracket_matched": False, "parent_uid": None, "uid": None} | own


def random_book(rng, book, with_lost_parents):
    """An outline of random levels whose entries lie on random pages, and automatic headings in between."""
    rows, counts, stack = [], [0] * 5, []
    for n in range(rng.randrange(4, 22)):
        level = rng.randrange(0, min(4, len(stack) + 2))
        counts[level] += 1
        counts[level + 1 :] = [0] * (4 - level)
        stack = [s for s in stack if s[0] < level]
        number = ".".join(map(str, counts[: level + 1]))
        rows.append({"level": level, "number": number, "uid": number, "parent_uid": stack[-1][1] if stack else None, "text": f"entry {n}", "bracket_matched": rng.random() < 0.5, "page_id": rng.randrange(1, 5)})
        stack.append((level, number))
    if with_lost_parents:
        rows = [r for r in rows if r["level"] == 0 or rng.random() < 0.7]
    for n in range(rng.randrange(0, 5)):
        rows.append({"level": rng.randrange(0, 4), "number": f"{n + 1}", "auto": True, "text": f"auto {n}", "page_id": rng.randrange(1, 5)})
    rng.shuffle(rows)
    out = []
    for page in range(1, 5):
        for k, r in enumerate(r for r in rows if r["page_id"] == page):
            out.append(heading(book, page, 0, k, k, **{c: v for c, v in r.items() if c != "page_id"}))
    return out


def stated(rows):
    """New number of each heading, as the module's three rules put it."""
    rows = [dict(r) for r in rows]
    place = lambda r: (r["page_id"], r["sub_idx"], r["positions"][0]["pi"], r["positions"][0]["li"], r["ord"])
    by_uid = {r["uid"]: r for r in rows if r["uid"]}
    parent = lambda r: by_uid.get(r["parent_uid"])
    rising = sorted((r for r in rows if r["level"] > 0 and (p := parent(r)) and p["bracket_matched"] and not p["implicit"] and p["page_id"] == r["page_id"] and place(r)[:4] < place(p)[:4]
                     and p["level"] < r["level"] and not (p["level"] == 0 and (r["auto"] or r["implicit"]))), key=place)
    for r in rising[:1]:
        r["level"], r["parent_uid"] = parent(r)["level"], parent(r)["parent_uid"]
    number, top, before = {}, 0, 0
    given: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["level"], place(r))):
        if r["level"] == 0:
            top += 1
            if r not in rising[:1]:
                top = max(top, int(r["number"].split(".")[0]))
            new = str(top)
        elif parent(r):
            given[r["parent_uid"]] = given.get(r["parent_uid"], 0) + 1
            new = f"{number[r['parent_uid']]}.{given[r['parent_uid']]}"
        else:
            new = str(before + 1)
        before = int(new.split(".")[0])
        if r["uid"]:
            number[r["uid"]] = new
        r["new"] = new
    return {(r["book_id"], r["text"]): r["new"] for r in rows}


@pytest.mark.parametrize("lost", [False, True])
def test_numbers_are_as_stated(spark, lost):
    rng = random.Random(lost)
    books = {k: random_book(rng, k, lost) for k in range(40)}
    got = renumber.renumbered(spark.createDataFrame([r for b in books.values() for r in b], anchor.HEADING)).collect()
    want = {k: v for b in books.values() for k, v in stated(b).items()}
    found = {(r.book_id, r.text): r.number for r in got}
    assert len(got) == len(found) and len({b for b, _ in found}) > 20
    assert found == {k: v for k, v in want.items() if k[0] in {b for b, _ in found}}
