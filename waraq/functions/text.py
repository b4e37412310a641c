"""Text functions, each stated once as a recipe of steps.

A recipe runs as a chain of built-in column expressions, and as plain Python inside ordered folds.  Character classes are spelled out, as Java and Python differ in what ``\\d`` and ``\\s`` hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"\t\n\x{000B}\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGITS = r"0-9\x{0660}-\x{0669}"
# Vowel signs and other marks; letters written alike; what editors' notes hold; punctuation; brackets.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
ALIKE = ("آأإىةؤئ", "ااايهوي")
NOTE_INSIDE = rf"[{DIGITS}{BLANK}،,.\-/\x{{0623}}-\x{{064A}}]+"
PUNCTUATION = "،؟!.,;:-()[]{}«»‹›/\"'“”‘’"
BRACKETS = "-[]（）().「」【】《》〈〉«»‹›"
EDGES = BRACKETS + " :،ـ"
# Colours of the five classes of coloured text.
COLOURS = {"c1": "#5f0000", "c2": "#005300", "c3": "#686800", "c4": "#707070", "c5": "#005c81"}
# Entities that lines hold; & comes last.
ENTITIES = (("&nbsp;", "\u00a0"), ("&shy;", "\u00ad"), ("&#8203;", "\u200b"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def characters(of_class: str) -> str:
    """The characters of a class or of its inside, spelled out."""
    pattern = re.compile(as_python(of_class if of_class.startswith("[") else f"[{of_class}]"))
    return "".join(c for c in map(chr, range(0x3100)) if pattern.fullmatch(c))


def as_python(pattern: str) -> str:
    """A pattern in Python's spelling."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern).replace(r"\z", r"\Z")


class Recipe:
    """Steps over a text: ("re", pattern, replacement), ("put", text, replacement), ("map", from, to), where what lacks a counterpart is deleted, ("strip", characters), or ("entities",): HTML entities resolved."""

    def __init__(self, *steps: tuple):
        self.steps = steps

    def __add__(self, other: Recipe) -> Recipe:
        return Recipe(*self.steps, *other.steps)

    def column(self, c: Column | str) -> Column:
        """The recipe over a column."""
        out = F.col(c) if isinstance(c, str) else c
        for kind, *x in self.steps:
            if kind == "re":
                out = F.regexp_replace(out, x[0], x[1])
            elif kind == "put":
                out = F.replace(out, F.lit(x[0]), F.lit(x[1]))
            elif kind == "map":
                out = F.translate(out, x[0], x[1])
            elif kind == "entities":
                out = resolved(out)
            else:
                out = F.btrim(out, F.lit(x[0]))
        return out

    def python(self) -> Callable[[str], str]:
        """The recipe over a string."""
        ready = []
        for kind, *x in self.steps:
            if kind == "re":
                ready.append((re.compile(as_python(x[0])).sub, x[1]))
            elif kind == "map":
                ready.append((str.translate, str.maketrans(x[0][: len(x[1])], x[1], x[0][len(x[1]) :])))
            elif kind == "entities":
                ready.append((_unescaped, None))
            else:
                ready.append((kind, x))

        def run(text: str) -> str:
            for step, x in ready:
                text = text.replace(*x) if step == "put" else text.strip(*x) if step == "strip" else step(text, x) if step is str.translate or step is _unescaped else step(x, text)
            return text

        return run


def _unescaped(text: str, _: object) -> str:
    return html.unescape(text)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All HTML entities resolved, named and numeric."""
    return s.map(html.unescape, na_action="ignore")


def resolved(c: Column) -> Column:
    """Text with all HTML entities resolved: those that lines commonly hold by built-in functions; only texts with others are sent to Python."""
    common = "|".join(e[1:-1] for e, _ in ENTITIES)
    others = F.coalesce(c.rlike(f"&(?!(?:{common});)[#A-Za-z]"), F.lit(False))
    quick = c
    for entity, shown in ENTITIES:
        quick = F.replace(quick, F.lit(entity), F.lit(shown))
    return F.when(others, unescape(F.when(others, c))).otherwise(quick)


PLAIN = Recipe(("re", "<[^>]+>", ""), ("entities",))
STRIP = Recipe(("strip", characters(BLANK)))
NO_NOTES = Recipe(("re", rf"\({NOTE_INSIDE}\)", ""), ("re", rf"\[{NOTE_INSIDE}\]", ""))
#: Every run of blanks becomes one space; single spaces are no match and stay untouched.
FOLD_BLANKS = Recipe(("re", rf" [{BLANK}]+|[{BLANK.replace(' ', '')}][{BLANK}]*", " "))
#: Letters written alike to one of them, punctuation to spaces, marks away, in one pass; then the edges and the blanks.
FOLD = Recipe(("map", ALIKE[0] + PUNCTUATION + characters(MARKS), ALIKE[1] + " " * len(PUNCTUATION)), ("strip", EDGES)) + FOLD_BLANKS + Recipe(("strip", " "))
#: Canonical form in which labels and lines are compared.
NORMAL_PLAIN = NO_NOTES + Recipe(("re", rf"^\[[^\]]*\][{BLANK}]+", "")) + FOLD + Recipe(("re", rf"^[{DIGITS}]+[{BLANK}\-.)\]}}]*", ""), ("strip", " "))
NORMAL = PLAIN + NORMAL_PLAIN
#: Weaker form for texts of which the canonical one leaves nothing: notes and digits stay.
LIGHT_PLAIN = FOLD
LIGHT = PLAIN + LIGHT_PLAIN
INSIDE_PLAIN = STRIP + Recipe(("strip", BRACKETS)) + STRIP
INSIDE_BRACKETS = PLAIN + INSIDE_PLAIN
ESCAPE = Recipe(("put", "&", "&amp;"), ("put", "<", "&lt;"), ("put", ">", "&gt;"), ("put", '"', "&quot;"), ("put", "'", "&#x27;"))
SAFE = Recipe(("re", rf"[^{BLANK}A-Za-z0-9_À-ÖØ-öø-ÿ\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}-]", "_")) + STRIP + FOLD_BLANKS + Recipe(("strip", " ."))
#: A leading span of the title colour, with its text.
TITLE_COLOUR = Recipe(("re", rf'^<span[^>]*(?:class="?c5"?|color:#005c81)[^>]*>.*?</span>[{BLANK}]*', "")) + STRIP
#: Text of a line measured against its label; notes stay.
EXTRA = PLAIN + STRIP + Recipe(("map", "،؟!.,;:-", " " * 8)) + FOLD_BLANKS + Recipe(("strip", " "), ("strip", EDGES), ("map", characters(MARKS), "")) + STRIP
BRACKET_LINE = r"^\[.*\]\z"
NOTE = rf"\({NOTE_INSIDE}\)|\[{NOTE_INSIDE}\]"
DOTS_ONLY = r"^\.+\z"


def plain_text(c) -> Column:
    """Text of a fragment: tags dropped, entities resolved."""
    return PLAIN.column(c)


def normalize(c) -> Column:
    """Canonical form for comparing labels with lines; a label of nothing but notes or digits becomes empty."""
    return NORMAL.column(c)


def bracket_text(c) -> Column:
    """Inner text of a line that is in square brackets as a whole, else null."""
    bare = STRIP.column(PLAIN.column(c))
    return F.when(bare.rlike("(?s)" + BRACKET_LINE), INSIDE_BRACKETS.column(c))


def with_line_forms(lines: DataFrame, html: str = "html") -> DataFrame:
    """``lines`` with ``bracket``, the inner text of bracket lines, and ``norm``, the form in which labels are sought.

    ``norm`` is the canonical form, or where that is empty a weaker one; null becomes empty.  Each step is a column of its own, so that none is computed twice.
    """
    rows = lines.withColumn("_plain", PLAIN.column(html)).withColumn("_bare", STRIP.column("_plain"))
    rows = rows.withColumn("bracket", F.nullif(F.when(F.col("_bare").rlike("(?s)" + BRACKET_LINE), INSIDE_PLAIN.column("_bare")), F.lit("")))
    rows = rows.withColumn("_shown", F.coalesce("bracket", "_plain", F.lit(""))).withColumn("norm", NORMAL_PLAIN.column("_shown"))
    return rows.withColumn("norm", F.when(F.col("norm") == "", LIGHT_PLAIN.column("_shown")).otherwise(F.col("norm"))).drop("_plain", "_bare", "_shown")


def escape_html(c) -> Column:
    """HTML-escaped text; null becomes empty."""
    return ESCAPE.column(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def truncate_title(c, words: int = 5) -> Column:
    """Titles of more than ``words`` words shortened to the first words, an ellipsis and the last word."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(STRIP.column(c), rf"[{BLANK}]+")
    return F.when(F.size(parts) <= words, c).otherwise(F.concat(F.array_join(F.slice(parts, 1, words - 1), " "), F.lit(" … "), F.element_at(parts, -1)))


def safe_name(c, longest: int = 80, fallback: str = "unknown") -> Column:
    """Text usable as one path component."""
    clean = SAFE.column(c)
    return F.coalesce(F.nullif(F.rtrim(F.substring(clean, 1, longest)), F.lit("")), F.lit(fallback))


def strip_title_colour(c) -> Column:
    """Line without its leading span of the title colour."""
    return TITLE_COLOUR.column(STRIP.column(c))


def has_note(c) -> Column:
    """Whether the line's text has an editor's note in brackets."""
    return PLAIN.column(c).rlike(NOTE)


def has_extra_content(line, label) -> Column:
    """Whether a line says more than its label: not when only notes differ, else when over 3 characters longer."""
    line, label = (F.col(x) if isinstance(x, str) else x for x in (line, label))
    return ~(NORMAL.column(NO_NOTES.column(STRIP.column(PLAIN.column(line)))) == NORMAL.column(label)) & (F.length(EXTRA.column(line)) > F.length(STRIP.column(F.regexp_replace(label, MARKS, ""))) + 3)


_normal, _light, _plain, _no_notes, _extra, _strip = (r.python() for r in (NORMAL, LIGHT, PLAIN, NO_NOTES, EXTRA, STRIP))
_note = re.compile(as_python(NOTE)).search
_marks = re.compile(as_python(MARKS)).sub
_lead_marks = re.compile("^" + as_python(MARKS) + "+").sub


def says_more(line: str, normal_label: str) -> bool:
    """``has_extra_content`` for the ordered folds."""
    if _normal(_no_notes(_strip(_plain(line)))) == _normal(normal_label):
        return False
    return len(_extra(line)) > len(_strip(_marks("", normal_label))) + 3


def in_brackets(line: str) -> bool:
    """Whether a line is in square brackets as a whole."""
    bare = _strip(_plain(line))
    return bare.startswith("[") and bare.endswith("]")


def note_in(line: str) -> bool:
    """``has_note`` for the ordered folds."""
    return _note(_plain(line)) is not None


def normal(text: str) -> str:
    """``normalize`` for the ordered folds."""
    return _normal(text)


def anchor_form(text: str) -> str:
    """``anchoring`` for the ordered folds."""
    return _normal(text) or _light(text)


def unwrap_title(line: str, label: str) -> str:
    """A line without the brackets around its title; notes inside or after the brackets stay."""
    bare = _strip(line)
    if not bare.startswith("["):
        return line
    if bare.endswith("]"):
        return _strip(bare[1:-1])
    inner, found, rest = bare[1:].partition("]")
    return _strip(inner + rest) if found and _normal(inner) == _normal(label) else line


def without_heading(body: str, heading: str) -> str:
    """A body line without its heading: cut after it where it begins with it as stored, or after the letters that make its canonical form."""
    title = _strip(heading)
    end = len(title) if body.startswith(title) else None
    if end is None:
        letters = [(at, form) for at, c in enumerate(body) if (form := _normal(c))]
        wanted = _normal(title).replace(" ", "")
        if not _normal(body).startswith(_normal(title)) or not "".join(form for _, form in letters).startswith(wanted):
            return body
        reached = [k for k, total in enumerate(accumulate(len(form) for _, form in letters)) if total >= len(wanted)] if wanted else []
        end = letters[reached[0]][0] + 1 if reached else 0
        end += len(body[end:]) - len(_lead_marks("", body[end:]))
    return _strip(body[end:]).lstrip(" ,.-،:")


def extract_id(c, kind: str) -> Column:
    """Number after ``/<kind>/`` in an address."""
    return F.nullif(F.regexp_extract(c, rf"/{kind}/([0-9]+)", 1), F.lit("")).try_cast("int")


def digits(c) -> Column:
    """First number of a text, in Latin or Arabic-Indic digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789"), "([0-9]+)", 1), F.lit("")).try_cast("int")
