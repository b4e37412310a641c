"""Text rules in DuckDB's SQL, written from their contracts and not from the recipes that they check."""

from __future__ import annotations

_SPACE = r"\t-\r\x{85}\p{Z}"
_EDITORS = rf"[0-9٠-٩{_SPACE}،,./\x{{0623}}-\x{{064A}}-]+"
_VOWELS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
_BRACKET = r"\-\[\]（）().「」【】《》〈〉«»‹›"


def _gone(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def bare(x: str) -> str:
    """Without blanks of any kind at the ends."""
    return _gone(x, rf"^[{_SPACE}]+|[{_SPACE}]+$")


def squeezed(x: str) -> str:
    """Runs of blanks as one space."""
    return _gone(x, rf"[{_SPACE}]+", " ")


def plain(x: str) -> str:
    """Without tags, entities resolved; those of the tables, the ampersand's last."""
    x = _gone(x, "<[^>]+>")
    for entity, shown in (("&nbsp;", "chr(160)"), ("&shy;", "chr(173)"), ("&#8203;", "chr(8203)"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&apos;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {shown})"
    return x


def without_notes(x: str) -> str:
    """Without round, then square groups that hold only what editors put there."""
    return _gone(_gone(x, rf"\({_EDITORS}\)"), rf"\[{_EDITORS}\]")


def normal(x: str) -> str:
    """The canonical form: notes, a leading reference, letters alike, marks, punctuation, edges, blanks, a leading number."""
    x = _gone(without_notes(plain(x)), rf"^\[[^\]]*\][{_SPACE}]+", flags="")
    for alike, one in (("آأإ", "ا"), ("ى", "ي"), ("ة", "ه"), ("ؤ", "و"), ("ئ", "ي")):
        x = _gone(x, f"[{alike}]", one)
    x = _gone(_gone(x, _VOWELS), r"""[،؟!.,;:()\[\]{}«»‹›/"'“”‘’-]""", " ")
    x = _gone(x, rf"^[{_BRACKET} :،ـ]+|[{_BRACKET} :،ـ]+$")
    return f"trim({_gone(f'trim({squeezed(x)})', rf'^[0-9٠-٩]+[{_SPACE}.)}}\]-]*', flags='')})"


def escaped(x: str) -> str:
    """HTML-escaped; null is empty."""
    x = f"replace(coalesce({x}, ''), '&', '&amp;')"
    for c, shown in (("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&quot;"), ("chr(39)", "&#x27;")):
        x = f"replace({x}, {c}, '{shown}')"
    return x


def safe_name(x: str, longest: int = 80) -> str:
    """One component of a path: what is no word character, blank or hyphen of the two scripts becomes a low line."""
    word = r"A-Za-z0-9_À-ÖØ-öø-ÿ\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}-"
    x = f"trim({squeezed(bare(_gone(x, f'[^{_SPACE}{word}]', '_')))}, ' .')"
    return f"coalesce(nullif(rtrim(substring({x}, 1, {longest})), ''), 'unknown')"


def uncoloured(x: str) -> str:
    """A line without its leading span of the title colour, and that span's text."""
    return bare(_gone(bare(x), rf'^<span[^>]*(class="?c5"?|color:#005c81)[^>]*>.*?</span>[{_SPACE}]*', flags=""))


def is_noted(x: str) -> str:
    """Whether the text has an editor's note in round or square brackets."""
    return f"regexp_matches({plain(x)}, '\\({_EDITORS}\\)|\\[{_EDITORS}\\]')"


def in_brackets(x: str) -> str:
    """Whether the text as a whole is in square brackets."""
    return f"(starts_with({bare(plain(x))}, '[') AND ends_with({bare(plain(x))}, ']') AND length({bare(plain(x))}) > 1)"


def inside(x: str) -> str:
    """Text between the brackets at both ends."""
    return bare(_gone(bare(plain(x)), rf"^[{_BRACKET}]+|[{_BRACKET}]+$"))


def is_digits(x: str) -> str:
    """Whether a label is nothing but digits and blanks."""
    return f"coalesce(regexp_full_match({bare(x)}, '[0-9٠-٩{_SPACE}]+'), false)"


def shortened(x: str) -> str:
    """Over five words: the first four, an ellipsis, the last."""
    words = f"string_split_regex({bare(x)}, '[{_SPACE}]+')"
    return f"CASE WHEN len({words}) <= 5 THEN {x} ELSE array_to_string({words}[1:4], ' ') || ' … ' || {words}[-1] END"


def says_more(line: str, label: str) -> str:
    """Whether a line says more than its label: not when only notes differ, else when over 3 characters longer."""
    text = _gone(f"trim({squeezed(_gone(bare(plain(line)), '[،؟!.,;:-]', ' '))})", rf"^[{_BRACKET} :،ـ]+|[{_BRACKET} :،ـ]+$")
    own = normal(without_notes(bare(plain(line))))
    return f"{own} <> {normal(label)} AND length({bare(_gone(text, _VOWELS))}) > length({bare(_gone(label, _VOWELS))}) + 3"
