import json
import random

import pytest

from waraq.operators.nested import NestedRecords, TreeAutomaton, as_json, flatten, parse, subtype_table

SCHEMA = "record_id bigint, book_id int, meta string, seq int, label string, text string"


def nested(spark, texts):
    return NestedRecords(spark.createDataFrame([(k, 1, t, 5, "clash", "clash") for k, t in enumerate(texts)], SCHEMA))


def naive(value, out, parent):
    for x in [value] if isinstance(value, dict) else value if isinstance(value, list) else []:
        if isinstance(x, dict):
            out.append(parent)
            naive(x.get("children"), out, len(out) - 1)
    return out


def random_toc(rng, depth):
    node = {}
    if rng.random() < 0.8:
        node["label"] = rng.choice(["a", None, 3, {"text": "b"}, ["c"]])
    if rng.random() < 0.8:
        node["page_id"] = rng.choice([1, "٢", "x", None, {"value": 4, "printed": 5}, 1.5, True])
    if depth and rng.random() < 0.7:
        kids = [rng.choice([random_toc(rng, depth - 1), None, 5]) for _ in range(rng.randrange(4))]
        node["children"] = rng.choice([kids, kids[0] if kids else None, kids])
    if rng.random() < 0.2:
        node["notes"] = [{"label": "no node", "children": [{"label": "nor this"}]}]
    return node


def test_equals_recursion(spark):
    rng = random.Random(1)
    tocs = [[random_toc(rng, 4) for _ in range(3)] for _ in range(40)]
    wrap = [lambda t: {"toc": t}, lambda t: {"meta": {"toc": t}}, lambda t: {"batch": {"items": [{"meta": {"toc": json.dumps(t)}}]}}, lambda t: {"toc": json.dumps(json.dumps(t)), "related": [{"label": "x", "children": []}]}]
    rows = nested(spark, [json.dumps(wrap[k % 4](t)) for k, t in enumerate(tocs)]).nodes().collect()
    for k, t in enumerate(tocs):
        own = sorted((r.seq, r.parent_seq) for r in rows if r.record_id == k)
        assert own == list(enumerate(naive(t, [], -1)))


def test_odd_records(spark):
    texts = [None, "", "{", "[1,2", "nul", "3", "null", '{"toc": null}', '{"toc": []}', '{"toc": {"label": "one"}}', '{"toc": "not json"}', '{"toc": [NaN]}', '{"a": 1,}', "{'toc': []}", '{"toc": [[{"label": 1}], 4, "x", null]}', '﻿{"toc": [{}]}']
    n = nested(spark, texts)
    records = {r.record_id: r for r in n.records().collect()}
    assert [k for k, r in records.items() if not r.well_formed] == [0, 1, 2, 3, 4, 11, 12, 13, 15]
    assert {k: r.n_nodes for k, r in records.items() if r.n_nodes} == {9: 1}


def test_very_deep_and_very_long(spark):
    deep = '{"toc": [' + '{"label": "x", "children": [' * 30000 + "]}" * 30000 + "]}"
    long = json.dumps({"toc": [{"label": "ب" * 2_000_000, "page_id": k} for k in range(3)]}, ensure_ascii=False)
    cut = deep[:-1]
    got = {r.record_id: (r.n_nodes, r.max_depth, r.well_formed) for r in nested(spark, [deep, long, cut]).records().collect()}
    assert got == {0: (30000, 29999, True), 1: (3, 0, True), 2: (0, None, False)}


@pytest.mark.parametrize("text", ['{"a" 1}', '{"a": 1 "b": 2}', "[1,]", "[,1]", '{"a":}', "[1 2]", '{1: 2}', "]", '{"a": [}]', "01", "[1]]"])
def test_stack_reader_refuses_what_the_other_refuses(text):
    from waraq.operators.nested import _parse_deep

    for read in (parse, _parse_deep):
        with pytest.raises(ValueError):
            read(text)


def test_stack_reader_agrees():
    from waraq.operators.nested import _parse_deep

    rng = random.Random(3)
    for _ in range(200):
        value = {"toc": [random_toc(rng, 3)], "x": [1.5e3, -2, "é\n\"", {}, [], True, None]}
        assert _parse_deep(json.dumps(value, indent=rng.choice([None, 1]))) == value


def test_empty_table_and_repeats(spark):
    assert nested(spark, []).nodes().collect() == [] and nested(spark, []).records().collect() == []
    rows = spark.createDataFrame([(1, 1, '{"toc": [{}]}', 0, "", "")] * 2 + [(None, None, '{"toc": [{}]}', 0, "", "")], SCHEMA)
    assert sorted(str(r.record_id) for r in NestedRecords(rows).nodes().collect()) == ["1", "1", "None"]


def test_subtypes_hold_every_node_once_and_keep_links(spark):
    toc = [{"label": "a", "page_id": 1, "children": [{"page_id": "٢"}, {"page_id": {"value": 4, "printed": 5}}]}, {"label": "b"}, {"page_id": [1]}]
    nodes = nested(spark, [json.dumps({"toc": toc})]).nodes()
    parts = {k: subtype_table(nodes, k).collect() for k in ("page_int", "page_text", "page_object", "page_none", "page_odd")}
    assert sorted(r.seq for rows in parts.values() for r in rows) == [0, 1, 2, 3, 4]
    assert (parts["page_text"][0].page_number, parts["page_text"][0].parent_seq) == (2, 0)
    assert (parts["page_object"][0].page_value, parts["page_object"][0].page_printed) == (4, 5)


def test_automaton_state_depends_on_children():
    a = TreeAutomaton()
    assert a.state({"label": "x"}, set())[0] != a.state({"label": "x"}, {"v"})[0]
    assert a.state({"label": "x"}, {"v"}) == a.state({"label": "y"}, {"v"}) == TreeAutomaton().state({"label": "z"}, {"v"})
    assert a.state({"label": "x", "page_id": 1}, set()) != a.state({"label": "x", "page_id": 1, "editor": {}}, set())
    shape = lambda leaf: flatten(json.dumps({"toc": [{"label": "a", "children": [{"label": "b", "children": [leaf]}]}]}), a)[1][0]["variant"]
    assert shape({"label": "c"}) == shape({"label": "d"}) != shape({"label": None})
    assert flatten('{"toc": [{"children": {"label": "single"}}]}', a)[1][1]["parent_seq"] == 0


def test_odd_pages_are_a_registered_table(spark, tmp_path):
    from waraq.plans.problems import QUERIES

    toc = [{"page_id": True}, {"page_id": 1.5}, {"page_id": [1, {"a": "ب"}]}, {"page_id": " "}, {"page_id": "x"}, {"page_id": 3}, {"label": "b"}]
    spark.createDataFrame([(1, 1, json.dumps({"toc": toc}))], "record_id bigint, book_id int, meta string").write.parquet(f"{tmp_path}/book_meta.parquet")
    got = {r.seq: r.page_json for r in QUERIES["p3_page_odd"](spark, str(tmp_path)).collect()}
    assert got == {0: "true", 1: "1.5", 2: '[1,{"a":"ب"}]', 3: '" "', 4: '"x"'}


def test_no_value_is_lost(spark):
    toc = [{"page_id": 3000000000}, {"page_id": "1234567890123456789012"}, {"page_id": 1.5}, {"page_id": 10**30}, {"page_id": {"value": 4, "printed": "x", "more": [1]}}, {"level": "deep", "label": {"text": "a", "lang": "ar"}}, {"level": "٣"}]
    n = nested(spark, [json.dumps({"toc": toc}), '{"toc": [[{"label": 1}], 4, null, {"children": "none"}, {"children": [[], {}]}]}', '{"toc": 7}'])
    rows = {r.seq: r for r in n.nodes().where("record_id = 0").collect()}
    assert rows[0].page_int == 3000000000 and rows[1].page_text == "1234567890123456789012" and rows[1].page_number is None
    assert (rows[2].page_json, rows[3].page_json, rows[4].page_json) == ("1.5", str(10**30), '{"value":4,"printed":"x","more":[1]}') and rows[3].subtype == "page_odd"
    assert (rows[5].level_json, rows[5].label, rows[5].label_json, rows[6].level_stated) == ('"deep"', "a", '{"text":"a","lang":"ar"}', 3)
    strays = sorted((r.record_id, r.parent_seq, r.position if r.position is not None else -1, r.value_json) for r in n.strays().collect())
    assert strays == [(1, -1, 0, '[{"label":1}]'), (1, -1, 1, "4"), (1, 0, -1, '"none"'), (1, 1, 0, "[]"), (2, -1, -1, "7")]
    variants = n.variants().collect()
    assert sum(r.n_nodes for r in variants) == 10 and len({r.variant for r in variants}) == len(variants)


def test_json_of_any_depth():
    value = parse('{"a": ' + '[{"b": ' * 5000 + '[1, "x", {}, []]' + "}]" * 5000 + "}")
    assert as_json(value) == '{"a":' + '[{"b":' * 5000 + '[1,"x",{},[]]' + "}]" * 5000 + "}"
