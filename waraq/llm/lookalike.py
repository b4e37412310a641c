"""Visually identical text with different characters (problem 5).

1. Compatibility forms that differ in width or stored form only are resolved, characters without a drawn shape are
   deleted, blanks are folded, and every letter is split into its base and its marks, marks in one order.
2. Every base gets its *visual class* at its place in the word: Farsi yeh is drawn with dots where it joins the
   next letter and without them where it doesn't, keheh is a kaf only where it joins, and so on.
3. A class is a set of look-alike letters, so a token is a lattice.  Viterbi picks the path that a character bigram
   model of the whole corpus, with a charge for every change of script, likes best.

The lattice depends on the classes only, and at a given place each letter is in one class only.  So two texts get
the same form exactly when their classes agree, and the form is spelled with the letters usual in the corpus.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of different scripts that are drawn alike, the Latin one first.
LOOK_ALIKES = (
    "AΑА BΒВ CСϹ EΕЕ FϜ GԌ HΗН IΙІӀ JЈͿ KΚК MΜМϺ NΝ OΟОՕ PΡР QԚ SЅՏ TΤТ VѴ WԜ XΧХ YΥҮ ZΖ "
    "aа cсϲ dԁ eе gɡց hһ iі jјϳ lӏ oοоօ pр qԛ sѕ uս vνѵ wԝ xх yу "
    "ΓГ ΠП ΦФ ΛЛ εє"
).split()
# Hyphens drawn alike.
HYPHENS = "-‐⁃˗֊"
# Arabic-Indic digits and those Extended Arabic-Indic digits drawn the same way (4, 5 and 6 differ).
DIGITS = tuple("٠۰ ١۱ ٢۲ ٣۳ ٧۷ ٨۸ ٩۹".split())
# Letters alike where they join the next letter, and where they don't.
JOINED = ("يی", "كک", "هھ")
UNJOINED = ("ىی", "هەہ", "ةۃ")
# Fixed value: drawn as a heh that doesn't join, even before letters that a heh joins.
AE = "\u06d5"
# Yehs that lose their dots under a hamza.
YEHS = "يىی"
HAMZA_ABOVE = "ٔ"
# Arabic letters that don't join the following letter.
RIGHT_JOINING = frozenset("اأإآٱدذرزژڈڑوؤةۃەىۇۆۈۋ".replace("ى", "")) | {"ٲ", "ٳ", "ٵ"}
# Format characters that have a drawn shape.
DRAWN_FORMATS = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢")
# Characters without a drawn shape outside the format and control categories.
SHAPELESS = frozenset("͏ᅟᅠ឴឵᠋᠌᠍᠏⁥⠀ㅤﾠ")
# Compatibility letters that are drawn differently from what they stand for.
DRAWN_OTHERWISE = frozenset("ſﬅϐϑϒϕϖϰϱϴϵ")
#: Kinds of compatibility mapping that change width or stored form, not the drawing.
SAME_DRAWING = frozenset(["<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>"])
#: Charge in the lattice for a letter of another script than the one before.
SCRIPT_CHANGE = 6.0
#: Distinct tokens kept per worker before the cache is emptied.
CACHE_TOKENS = 400_000
ALPHABET = 512

_TAG = re.compile(r"<[A-Za-z/!][^>]*>")


def plain(fragment: str) -> str:
    """Text of a line: tags removed, entities resolved, nothing else."""
    if "<" in fragment:
        fragment = _TAG.sub("", fragment)
    return html_lib.unescape(fragment) if "&" in fragment else fragment


def _tables() -> tuple[dict[int, str | None], re.Pattern]:
    """Mapping of compatibility and shapeless characters, by rule over the code points that can be such."""
    table: dict[int, str | None] = {}
    for point in (*range(0x10000), *range(0xE0000, 0xE0200)):
        c = chr(point)
        kind = unicodedata.category(c)
        if (kind == "Cf" and c not in DRAWN_FORMATS) or (kind == "Cc" and not c.isspace()) or c in SHAPELESS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            table[point] = None
        elif (d := unicodedata.decomposition(c)).startswith("<") and d.split()[0] in SAME_DRAWING and c not in DRAWN_OTHERWISE:
            table[point] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    for point, to in list(table.items()):  # a mapping may lead to another one
        if to:
            table[point] = "".join(table.get(ord(x), x) or "" for x in to)
    return table, re.compile("[" + "".join(map(re.escape, map(chr, sorted(table)))) + "]")


_table_pair: tuple[dict, re.Pattern] | None = None


def tables() -> tuple[dict[int, str | None], re.Pattern]:
    """The tables of ``_tables``, made once a process."""
    global _table_pair
    if _table_pair is None:
        _table_pair = _tables()
    return _table_pair


_GLYPH = {member: group[0] for group in (*LOOK_ALIKES, HYPHENS, *DIGITS) for member in group}
_JOINED = {member: group[0] for group in JOINED for member in group}
_UNJOINED = {member: group[0] for group in UNJOINED for member in group}
_MEMBERS: dict[tuple[str, str], str] = {("", g[0]): g for g in (*LOOK_ALIKES, HYPHENS, *DIGITS)}
_MEMBERS |= {("j", g[0]): g for g in JOINED} | {("u", g[0]): g for g in UNJOINED} | {("h", YEHS[0]): YEHS}
_NOT_JOINING_BEFORE = frozenset("ءٴ")


def _arabic(c: str) -> bool:
    return ("ؠ" <= c <= "ي" or "ٮ" <= c <= "ۓ" or c == "ە" or "ۮ" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ࢠ" <= c <= "ࣇ") and unicodedata.category(c) in ("Lo", "Lm")


def classes(token: str) -> list[tuple[str, str, str]]:
    """(place, class, marks) of each letter of a token without blanks; the token is prepared here.

    Place is "j" or "u" for Arabic letters that join the next one or not, "h" for a yeh under hamza, "" elsewhere.
    """
    table, special = tables()
    if special.search(token):
        token = token.translate(table)
    units: list[list] = []
    for c in unicodedata.normalize("NFD", token):
        if unicodedata.combining(c) and units:
            units[-1][1].append(c)
        else:
            units.append([c, []])
    out = []
    for k, (base, marks) in enumerate(units):
        signs = "".join(sorted(marks))
        if _arabic(base):
            after = units[k + 1][0] if k + 1 < len(units) else ""
            goes_on = after != "" and (_arabic(after) or after == "ـ") and after not in _NOT_JOINING_BEFORE
            joins = base not in RIGHT_JOINING and base not in _NOT_JOINING_BEFORE and goes_on
            if base in YEHS and HAMZA_ABOVE in marks:
                out.append(("h", YEHS[0], signs))
            elif base == AE and goes_on:  # a heh would join here
                out.append(("u", base, signs))
            else:
                out.append(("j", _JOINED.get(base, base), signs) if joins else ("u", _UNJOINED.get(base, base), signs))
        else:
            glyph = _GLYPH.get(base, base)
            if glyph == "ı" and any(unicodedata.combining(m) == 230 for m in marks):
                glyph = "i"
            out.append(("", glyph, signs))
    return out


def script(c: str) -> str:
    """Script of a letter, from the first word of its Unicode name; "" for what belongs to all."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() or c.isdigit() and ord(c) > 127 else ""


def alphabet() -> list[str]:
    """Characters that the bigram model tells apart: all members of look-alike classes and plain Latin and Arabic letters."""
    own = {m for group in _MEMBERS.values() for m in group} | {chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x621, 0x64B))}
    return sorted(own)[: ALPHABET - 1]


class Model:
    """Character bigram model: log probability of a letter after another; index 0 stands for anything else."""

    def __init__(self, counts: np.ndarray):
        letters = alphabet()
        self.index = {c: k + 1 for k, c in enumerate(letters)}
        n = len(letters) + 1
        counts = counts[:n, :n].astype(np.float64) + 0.5
        self.score = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).tolist()
        self.script = {c: script(c) for c in letters}

    def best(self, lattice: list[str]) -> str:
        """The members, one per place, of the best path; ties go to the earlier member of a class."""
        paths = [(0.0, 0, "", "")]  # score, index, script, text so far; one path a member
        for members in lattice:
            step = []
            for m in members:
                i, s = self.index.get(m, 0), self.script.get(m, "")
                step.append(max(((p[0] + self.score[p[1]][i] - (SCRIPT_CHANGE if s and p[2] and s != p[2] else 0.0), i, s or p[2], p[3] + m) for p in paths), key=lambda p: p[0]))
            paths = step
        return max(paths, key=lambda p: p[0])[3]


class Former:
    """Forms of texts under a model, with a cache of tokens."""

    def __init__(self, model: Model):
        self.model = model
        self._cache: dict[str, str] = {}

    def token(self, token: str) -> str:
        """Form of one token; may be empty, or hold blanks where a character stands for one."""
        units = classes(token)
        picked = self.model.best([_MEMBERS.get((place, c), c) for place, c, _ in units])
        return "".join(c + signs for c, (_, _, signs) in zip(picked, units))

    def form(self, text: str) -> str:
        """The one form of a text: equal for two texts exactly when they look alike."""
        cache = self._cache
        out = []
        for token in text.split():
            got = cache.get(token)
            if got is None:
                if len(cache) >= CACHE_TOKENS:
                    cache.clear()
                got = " ".join(self.token(token).split())
                if len(token) <= 64:
                    cache[token] = got
            if got:
                out.append(got)
        return " ".join(out)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lookup = np.zeros(0x110000, dtype=np.int32)
    for k, c in enumerate(alphabet()):
        lookup[ord(c)] = k + 1
    total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
    for batch in batches:
        texts = [t for t in batch["text"] if t]
        for k in range(0, len(texts), 500):
            codes = lookup[np.frombuffer("\n".join(texts[k : k + 500]).encode("utf-32-le"), dtype=np.uint32)]
            total += np.bincount(codes[:-1] * ALPHABET + codes[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})


def train(texts: DataFrame) -> Model:
    """Bigram model of all texts; what reaches the driver is at most ALPHABET ** 2 counts."""
    rows = texts.mapInPandas(_count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
    counts[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return Model(counts.reshape(ALPHABET, ALPHABET))


def with_forms(df: DataFrame, text: str, model: Model, to_plain: Callable[[str], str] | None = None, digests: bool = False) -> DataFrame:
    """``df`` without ``text`` but with its form (``digests``: 128-bit digests ``form`` and ``stored`` instead).

    Null stays null.  A text of characters without a shape has the empty form.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    kind = "binary" if digests else "string"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ([f"form {kind}", f"stored {kind}"] if digests else [f"form {kind}"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        former = Former(model)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            shown = [None if t is None else to_plain(t) if to_plain else t for t in batch[text]]
            forms = [None if t is None else former.form(t) for t in shown]
            out = batch.drop(columns=[text])
            out["form"] = pd.Series([None if f is None else digest(f) if f else b"" for f in forms] if digests else forms, index=batch.index, dtype=object)
            if digests:
                out["stored"] = pd.Series([None if t is None else digest(t) for t in shown], index=batch.index, dtype=object)
            yield out

    return df.mapInPandas(run, schema)


class LookAlikes:
    """Entries and lines of one page that look the same.

    An entry without label, of an empty form, or with page_id null or 0 takes no part, nor does a null line.  Repeated ids
    give a pair once.  Columns beyond those named are ignored; empty tables give no pair.
    """

    def __init__(self, toc: DataFrame, lines: DataFrame):
        self._toc = toc.select(F.col("toc_id").cast("bigint").alias("toc_id"), "book_id", "page_id", F.col("label").alias("text"))
        self._lines = lines.select(F.col("line_id").cast("bigint").alias("line_id"), "book_id", "page_id", F.col("html").alias("text"))
        self.model = train(self._toc.select("text").union(self._lines.select("text")))

    def forms(self) -> DataFrame:
        """(kind, id, form) of every entry and line."""
        a = with_forms(self._toc.select(F.lit("toc").alias("kind"), F.col("toc_id").alias("id"), "text"), "text", self.model)
        b = with_forms(self._lines.select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), "text"), "text", self.model, plain)
        return a.union(b)

    def pairs(self) -> DataFrame:
        """(toc_id, line_id) of one page whose texts look the same but are not equal."""
        entries = self._toc.where(F.col("page_id").isNotNull() & (F.col("page_id") != 0) & F.col("text").isNotNull())
        a = with_forms(entries, "text", self.model, digests=True).where(F.length("form") > 0).toDF("toc_id", "book_id", "page_id", "form", "as_label")
        b = with_forms(self._lines.where(F.col("text").isNotNull()), "text", self.model, plain, digests=True).where(F.length("form") > 0)
        met = a.join(b.withColumnRenamed("stored", "as_line"), ["book_id", "page_id", "form"]).where("as_label <> as_line")
        return met.select("toc_id", "line_id").distinct()
