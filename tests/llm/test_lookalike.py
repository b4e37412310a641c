import random
import unicodedata

import pytest

from waraq.llm.lookalike import _MEMBERS, Former, LookAlikes, classes, plain, train

TOC = "toc_id bigint, book_id int, page_id int, label string, text string, form string"
LINES = "line_id bigint, book_id int, page_id int, html string, text string, stored string"


def tables(spark, toc, lines):
    return spark.createDataFrame([(*r, "clash", "clash") for r in toc], TOC), spark.createDataFrame([(*r, "clash", "clash") for r in lines], LINES)


@pytest.fixture(scope="module")
def former(spark):
    words = "باب في الكلام على النحو والصرف وما يتعلق به من القول كتاب The sound coin of Hobley section notes 12 ١٢٣ Kitab al-Nabat"
    return Former(train(spark.createDataFrame([(words,)] * 5, "text string")))


SAME = [
    ("في", "ف​ي"), ("باب الكلام", "  باب  الكلام "), ("النوع", "ﺍﻟﻨﻮﻉ"), ("الأصل", "الأصل"), ("مُلَّ", "مُلَّ"), ("يتعلق", "یتعلق"), ("على", "علی"), ("كتاب", "کتاب"),
    ("به", "بە"), ("١٢٣", "۱۲۳"), ("coin", "сοin"), ("The", "Τhе"), ("al-Nabat", "al‐Nabat"), ("al-Nabat", "al‑Nabat"), ("ｃｏｉｎ", "coin"), ("é", "é"), ("ﬁn", "fin"), ("a­b", "ab"),
    ("الإ", "اﻹ"), ("ئ", "ئ"), ("مسائل", "مسائل"), ("ā", "ā"), ("ï", "ї"), ("⁧باب⁩", "باب"),
]
DIFFERENT = [
    ("في", "فى"), ("على", "علي"), ("ملك", "ملک"), ("ة", "ه"), ("أ", "ا"), ("ق", "ف"), ("٤٥٦", "۴۵۶"), ("الجيش", "الجـيش"), ("كَتب", "كتب"), ("coin", "Coin"), ("coin", "coin."), ("e", "é"), ("a b", "ab"), ("a-b", "a b"),
    ("١", "1"), ("باب", "بات"), ("(a)", "a"), ("x²", "x2"), ("بـ", "ب"), ("ەب", "هب"), ("٣", "٤"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(former, a, b):
    assert former.form(a) == former.form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_look(former, a, b):
    assert former.form(a) != former.form(b)


def test_form_is_spelled_as_usual_and_stable(former):
    assert former.form("Τhe сοin") == "The coin" and former.form("وما یتعلق بە") == "وما يتعلق به"
    for text in ("Τhe сοin оf", "کتاب النحو", "﷽", "ạ́ b"):
        assert former.form(former.form(text)) == former.form(text)


def test_forms_agree_exactly_with_classes(former):
    rng = random.Random(2)
    pool = [*{m for g in _MEMBERS.values() for m in g}, *"بتقفأإؤئءا ", "َ", "ّ", "ٔ", "́", "​", "ـ"]
    seen = {}
    for _ in range(4000):
        token = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))).replace(" ", "")
        key = tuple(classes(token))
        form = former.form(token)
        assert seen.setdefault(("class", key), form) == form
        assert seen.setdefault(("form", form), key) == key or not form


def test_order_of_marks(former):
    marks = ["ّ", "َ", "ٔ", "ٰ"]
    forms = set()
    for k in range(24):
        random.Random(k).shuffle(marks)
        forms.add(former.form("ب" + "".join(marks)))
    assert len(forms) == 1


def test_plain():
    assert plain('<span class="c2">a</span>&nbsp;b<br>&amp;lt; 3 < 4 > 2') == "a b&lt; 3 < 4 > 2"


def test_pairs_and_edge_cases(spark):
    toc = [(1, 1, 5, "باب في النحو"), (2, 1, 5, None), (3, 1, None, "باب في النحو"), (4, 1, 0, "باب في النحو"), (5, 1, 5, ""), (6, 1, 5, "​"), (7, None, 5, "باب في النحو"), (8, 1, 5, "x" * 5000), (1, 1, 5, "باب في النحو"), (None, 1, 5, "باب")]
    lines = [(10, 1, 5, "باب فی النحو"), (11, 1, 5, "باب​ في  النحو"), (12, 1, 5, "<b>باب في النحو</b>"), (13, 1, 6, "باب​ في النحو"), (14, 1, 5, None), (15, 1, 5, ""), (16, 1, 5, "x" * 5000 + "﻿"), (17, 2, 5, "باب​ في النحو"), (18, 1, 0, "باب​ في النحو"),
             (11, 1, 5, "باب​ في  النحو"), (19, 1, 5, "باب&nbsp;في&nbsp;النحو")]
    got = LookAlikes(*tables(spark, toc, lines))
    assert sorted(map(tuple, got.pairs().collect())) == [(1, 11), (1, 19), (8, 16)]
    forms = {(r.kind, r.id): r.form for r in got.forms().collect()}
    assert forms["toc", 2] is None and forms["toc", 6] == "" and forms["line", 12] == forms["toc", 1]


def test_empty_tables(spark):
    empty = LookAlikes(*tables(spark, [], []))
    assert empty.pairs().collect() == [] and empty.forms().collect() == []


def test_every_member_is_alone_in_its_class_at_its_place():
    for place in ("", "j", "u", "h"):
        members = [m for (p, _), g in _MEMBERS.items() if p == place for m in g]
        assert len(members) == len(set(members))
    assert all(len(m) == 1 and unicodedata.normalize("NFD", m) == m for g in _MEMBERS.values() for m in g if m not in "ЇЙ")


def test_ae_is_a_heh_only_where_a_heh_would_not_join():
    from waraq.llm.lookalike import classes

    assert classes("ب\u06d5") == classes("به") and classes("ب\u06d5ء") == classes("بهء")
    assert classes("\u06d5ب")[0] == ("u", "\u06d5", "") and classes("\u06d5ـ")[0] == ("u", "\u06d5", "")
