"""Deeply nested records as related flat tables (problem 3).

A tree automaton runs bottom-up over every record: each JSON value gets a symbol (absent, null, text, digits,
integer, ...), and the state of a node follows from the symbols of *all* its members and from the set of states of its
children.  The state names the *structural variant* of the node, by a digest that is the same in every task; a change of shape
anywhere below a node changes its variant.  Variants fall into typed subtypes by how the
page number is stored; each subtype has a table of its own with columns of the right type, and all of them
share the keys of the supertype table (record_id, seq) and the link to the parent (record_id, parent_seq).

No value is lost: integers have 64 bits, what doesn't fit its typed column stands beside it as JSON text, and list elements that are no nodes have a table of
their own.  Records are independent, so the whole operator is one narrow pass: no shuffle, one record in memory at a time.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.shared import frame

NODE_COLUMNS = (
    "record_id bigint, book_id int, seq int, parent_seq int, depth int, n_children int, variant string, subtype string, label string, label_json string, page_number bigint, page_int bigint, "
    "page_text string, page_value bigint, page_printed bigint, page_json string, level_stated bigint, level_json string, other string"
)
STRAY_COLUMNS = "record_id bigint, book_id int, parent_seq int, position int, value_json string"
VARIANT_COLUMNS = "variant string, subtype string, shape string, n_nodes bigint"
RECORD_COLUMNS = "record_id bigint, book_id int, well_formed boolean, toc_path string, toc_kind string, n_nodes int, max_depth int, title string, author string"

#: Subtype of a node by the symbol of its page number.
SUBTYPES = {"int": "page_int", "digits": "page_text", "object": "page_object", "absent": "page_none", "null": "page_none"}

_ARABIC_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_DIGITS = re.compile(r"\s*-?[0-9]+\s*")
#: States kept per task before their table is emptied.
STATES = 100_000
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))', re.S)
_ABSENT = object()


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """The JSON value of ``text``; ValueError where it is not well-formed.  Any depth of nesting is read."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """Stack-based reader for texts nested too deep for the recursive one."""
    stack: list = []
    keys: list = []
    at, end = 0, len(text.rstrip(" \t\n\r"))
    value, have, expect_value = None, False, True
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at = m.end()
        mark, string, atom = m.groups()
        if mark in ("{", "["):
            if not expect_value:
                raise ValueError(f"unexpected {mark} before {at}")
            stack.append({} if mark == "{" else [])
            keys.append(_ABSENT)
            expect_value, have = True, False
            continue
        if mark in ("}", "]"):
            if not stack or isinstance(stack[-1], dict) != (mark == "}"):
                raise ValueError(f"unmatched {mark} before {at}")
            top = stack[-1]
            if have:
                _put(top, keys, value)
            elif top or keys[-1] is not _ABSENT:
                raise ValueError(f"missing value before {at}")
            value = stack.pop()
            keys.pop()
            have, expect_value = True, False
            continue
        if mark == ",":
            if not stack or not have:
                raise ValueError(f"unexpected , before {at}")
            _put(stack[-1], keys, value)
            have, expect_value = False, True
            continue
        if mark == ":":
            if not stack or not isinstance(stack[-1], dict) or not have or keys[-1] is not _ABSENT or not isinstance(value, str):
                raise ValueError(f"unexpected : before {at}")
            keys[-1] = value
            have, expect_value = False, True
            continue
        if not expect_value:
            raise ValueError(f"unexpected value before {at}")
        value, have, expect_value = json.loads(string or atom), True, False
    if stack or not have:
        raise ValueError("text ends early")
    return value


def _put(top, keys: list, value) -> None:
    if isinstance(top, dict):
        if keys[-1] is _ABSENT:
            raise ValueError("value without a key")
        top[keys[-1]] = value
        keys[-1] = _ABSENT
    else:
        top.append(value)


def find_toc(record) -> Iterator[tuple[str, object]]:
    """(path, value) of every ``toc`` member in stored order; nothing below a ``toc`` is searched."""
    stack = [("", record)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            below = []
            for key, inner in value.items():
                below.append((f"{path}/{key}" if path else key, inner))
            for item in reversed(below):
                stack.append(item)
            if path and path.rpartition("/")[2] == "toc":
                for _ in below:
                    stack.pop()
                yield path, value
        elif path.rpartition("/")[2] == "toc":
            yield path, value
        elif isinstance(value, list):
            stack.extend((f"{path}/[]", x) for x in reversed(value))


def symbol(value) -> str:
    """The alphabet of the automaton: what kind of JSON value a member is."""
    if value is _ABSENT:
        return "absent"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -(2**63) <= value < 2**63 else "large"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "digits" if _DIGITS.fullmatch(value.translate(_ARABIC_DIGITS)) else "text" if value.strip() else "blank"
    return "object" if isinstance(value, dict) else "list"


class TreeAutomaton:
    """Bottom-up automaton over nodes.

    The state of a node is (sorted members with their symbols, set of the states of its children); states are interned, and named by a digest of just that.
    """

    def __init__(self):
        self._states: dict[tuple, tuple[str, str, str]] = {}

    def state(self, node: dict, below: set[str]) -> tuple[str, str, str]:
        """(variant, subtype, shape) of a node, given the variants of its children."""
        sign = (tuple(sorted((k, symbol(v)) for k, v in node.items())), tuple(sorted(below)))
        if sign not in self._states:
            if len(self._states) >= STATES:
                self._states.clear()
            shape = _plain(", ".join(f"{k}:{kind}" for k, kind in sign[0]) + (f" < {', '.join(sign[1])}" if below else ""))
            variant = blake2b(repr(sign).encode("utf-8", "backslashreplace"), digest_size=10).hexdigest()
            self._states[sign] = (variant, SUBTYPES.get(symbol(node.get("page_id", _ABSENT)), "page_odd"), shape)
        return self._states[sign]


def as_int(value) -> int | None:
    """64-bit integer of a number or digits in any script; None otherwise."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        digits = value.translate(_ARABIC_DIGITS).strip()
        value = int(digits) if len(digits) <= 40 and _DIGITS.fullmatch(digits) else None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and -(2**63) <= value < 2**63 else None


def _plain(text: str) -> str:
    """Text without lone surrogates, which no column holds."""
    return text.encode("utf-8", "replace").decode("utf-8")


def as_text(value) -> str | None:
    """Text of a label: itself, or of an object its ``text``, ``value``, ``label`` or ``ar``, else its JSON."""
    if value is _ABSENT or value is None:
        return None
    if isinstance(value, dict):
        for key in ("text", "value", "label", "ar"):
            if isinstance(value.get(key), str):
                value = value[key]
                break
    return _plain(value) if isinstance(value, str) else as_json(value)


def as_json(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return _plain(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
    except RecursionError:
        pass
    out, stack = [], [("value", value)]
    while stack:
        kind, x = stack.pop()
        if kind == "mark":
            out.append(x)
        elif isinstance(x, dict):
            stack.append(("mark", "}"))
            for k, (key, inner) in reversed(list(enumerate(x.items()))):
                stack += [("value", inner), ("mark", ("," if k else "") + json.dumps(key, ensure_ascii=False) + ":")]
            out.append("{")
        elif isinstance(x, list):
            stack.append(("mark", "]"))
            for k, inner in reversed(list(enumerate(x))):
                stack += [("value", inner), *([("mark", ",")] if k else [])]
            out.append("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return _plain("".join(out))


def _elements(value) -> list[dict]:
    """The nodes directly in ``toc`` or ``children``: a list's objects, or a single object."""
    return [value] if isinstance(value, dict) else [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _strays(value, parent: int) -> Iterator[dict]:
    """What ``toc`` or ``children`` holds besides nodes: elements that are neither objects nor null, and a value that is no list at all."""
    if isinstance(value, list):
        yield from ({"parent_seq": parent, "position": k, "value_json": as_json(x)} for k, x in enumerate(value) if x is not None and not isinstance(x, dict))
    elif value is not _ABSENT and value is not None and not isinstance(value, dict):
        yield {"parent_seq": parent, "position": None, "value_json": as_json(value)}


def flatten(text: str | None, automaton: TreeAutomaton) -> tuple[dict, list[dict], list[dict]]:
    """The record's own row, the rows of its nodes, a node before its children, and those of its strays."""
    record = {"well_formed": False, "toc_path": None, "toc_kind": None, "title": None, "author": None}
    rows: list[dict] = []
    strays: list[dict] = []
    try:
        value = parse(text) if text is not None else None
        record["well_formed"] = text is not None
    except ValueError:
        return record, rows, strays
    for path, toc in find_toc(value):
        kind = symbol(toc)
        while isinstance(toc, str):
            try:
                toc = parse(toc)
            except ValueError:
                break
        if record["toc_path"] is None:
            record["toc_path"], record["toc_kind"] = _plain(path), kind
        strays += _strays(toc, -1)
        stack = [(x, -1, 0) for x in reversed(_elements(toc))]
        while stack:
            node, parent, depth = stack.pop()
            seq = len(rows)
            children, page, label, level = (node.get(k, _ABSENT) for k in ("children", "page_id", "label", "level"))
            below = _elements(children)
            strays += _strays(children, seq)
            inner = page if isinstance(page, dict) else {}
            rest = {k: v for k, v in node.items() if k not in ("label", "page_id", "level", "children")}
            stated, of_kind = as_int(level), SUBTYPES.get(symbol(page), "page_odd")
            rows.append({
                "seq": seq, "parent_seq": parent, "depth": depth, "n_children": len(below), "label": as_text(label), "label_json": as_json(label) if isinstance(label, (dict, list)) else None,
                "page_number": as_int(inner.get("value") if inner else page), "page_int": page if of_kind == "page_int" else None, "page_text": _plain(page) if isinstance(page, str) else None,
                "page_value": as_int(inner.get("value")), "page_printed": as_int(inner.get("printed")), "page_json": as_json(page) if of_kind in ("page_odd", "page_object") else None,
                "level_stated": stated, "level_json": as_json(level) if level is not _ABSENT and level is not None and stated is None else None,
                "other": as_json(rest) if rest else None, "_node": node, "_below": set(),
            })
            stack.extend((x, seq, depth + 1) for x in reversed(below))
    for row in reversed(rows):  # children come after their parent, so this is bottom-up
        row["variant"], row["subtype"], row["shape"] = automaton.state(row.pop("_node"), row.pop("_below"))
        if row["parent_seq"] >= 0:
            rows[row["parent_seq"]]["_below"].add(row["variant"])
    holder = _card(value)
    record |= {k: as_text(holder.get(k)) for k in ("title", "author")}
    return record, rows, strays


def _card(value) -> dict:
    """The object that holds the record's title: the first, outermost first, that has a title or a toc."""
    level = [value]
    while level:
        below = []
        for x in level:
            if isinstance(x, dict):
                if "title" in x or "toc" in x:
                    return x
                below += x.values()
            elif isinstance(x, list):
                below += x
        level = below
    return {}


class NestedRecords:
    """Flat tables of a table of JSON texts.

    Every record gets a row in ``records``; a text that is null or not well-formed has well_formed false and no
    nodes, one without ``toc`` or with an empty one has no nodes.  Repeated rows are flattened each for itself; an empty
    table gives empty tables; other columns are ignored.
    """

    def __init__(self, df: DataFrame, record_id: str = "record_id", text: str = "meta", book_id: str = "book_id"):
        self._in = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(book_id).cast("int").alias("book_id"), F.col(text).alias("text"))

    def records(self) -> DataFrame:
        """One row per record: (record_id, book_id, well_formed, toc_path, toc_kind, n_nodes, max_depth, title, author)."""
        return self._run(RECORD_COLUMNS, lambda record, nodes, strays: [record | {"n_nodes": len(nodes), "max_depth": max((n["depth"] for n in nodes), default=None)}])

    def nodes(self) -> DataFrame:
        """Supertype table: one row per node, linked to its record and parent, with variant, subtype and true depth."""
        return self._run(NODE_COLUMNS, lambda record, nodes, strays: nodes)

    def strays(self) -> DataFrame:
        """(record_id, book_id, parent_seq, position, value_json) of what lies in ``toc`` or ``children`` and is no node; position is null where it is no list."""
        return self._run(STRAY_COLUMNS, lambda record, nodes, strays: strays)

    def variants(self) -> DataFrame:
        """(variant, subtype, shape, n_nodes): the shape of a variant is its members and their kinds, and the variants of its children."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = TreeAutomaton()
            for batch in batches:
                met = Counter((n["variant"], n["subtype"], n["shape"]) for text in batch["text"] for n in flatten(text, automaton)[1])
                yield frame([{"variant": v, "subtype": t, "shape": shape, "n_nodes": n} for (v, t, shape), n in met.items()], VARIANT_COLUMNS)

        return self._in.mapInPandas(run, VARIANT_COLUMNS).groupBy("variant", "subtype", "shape").agg(F.sum("n_nodes").alias("n_nodes"))

    def _run(self, schema: str, rows_of) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = TreeAutomaton()
            for batch in batches:
                out: list[dict] = []
                for rid, book, text in zip(batch["record_id"].astype("Int64"), batch["book_id"].astype("Int64"), batch["text"]):
                    key = {"record_id": rid, "book_id": book}
                    out += [key | r for r in rows_of(*flatten(text, automaton))]
                    if len(out) >= 20_000:
                        yield frame(out, schema)
                        out = []
                yield frame(out, schema)

        return self._in.mapInPandas(run, schema)


def subtype_table(nodes: DataFrame, subtype: str) -> DataFrame:
    """The typed table of one subtype: keys, parent link, depth, label, and the columns that this subtype has."""
    own = {"page_int": ["page_int"], "page_text": ["page_text", "page_number"], "page_object": ["page_value", "page_printed", "page_json"], "page_none": [], "page_odd": ["page_number", "page_json"]}[subtype]
    return nodes.where(F.col("subtype") == subtype).select("record_id", "seq", "parent_seq", "depth", "label", *own)
