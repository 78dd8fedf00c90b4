"""Text clean-up on string columns."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The commonest character references, which `decode_entities` tries first.
ENTITIES = (
    ("nbsp", " "),
    ("lt", "<"),
    ("gt", ">"),
    ("quot", '"'),
    ("apos", "'"),
    ("#39", "'"),
    ("#34", '"'),
    ("amp", "&"),
)

# All other names of the HTML standard, by first letter, as JSON: one literal that folds to a
# map. Names that may stand without a semicolon are found by their beginning, longest first.
NAMED = json.dumps(
    {
        letter: {n[:-1]: c for n, c in html5.items() if n[0] == letter and n.endswith(";")}
        for letter in sorted({n[0] for n in html5})
    }
)
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
BARE = json.dumps({n: html5[n] for n in _BARE_NAMES})

# What numbers 128 to 159 stand for: the characters of windows-1252, as in browsers.
C1_CHARACTERS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def sql_text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_pattern(pattern: str) -> str:
    return f'r"{pattern}"'


# Decoding in SQL, of pieces `p` number `i` of a text that is cut at each `&`. As one lambda in
# SQL it is parsed at once; one-element arrays bind a value that is used several times.
_NUMBER = (
    f"CASE WHEN greatest(length(regexp_extract(p, {sql_pattern('^#[xX]0*([0-9a-fA-F]+)')}, 1)), "
    f"length(regexp_extract(p, {sql_pattern('^#0*([0-9]+)')}, 1))) > 7 THEN 1114112 "
    f"WHEN p RLIKE {sql_pattern('^#[xX]')} THEN CAST(conv(regexp_extract(p, {sql_pattern('^#[xX]0*([0-9a-fA-F]+)')}, 1), 16, 10) AS INT) "
    f"ELSE CAST(regexp_extract(p, {sql_pattern('^#0*([0-9]+)')}, 1) AS INT) END"
)
_CHARACTER = (
    "CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd' "
    f"WHEN n BETWEEN 128 AND 159 THEN substr({sql_text(C1_CHARACTERS)}, n - 127, 1) "
    "WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 "
    "OR n % 65536 >= 65534 THEN '' ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"
)
_NUMERIC = (
    f"transform(array(regexp_extract(p, {sql_pattern('^#(?:[xX][0-9a-fA-F]+|[0-9]+);?')}, 0)), f -> IF(f <> '', "
    f"concat(transform(array({_NUMBER}), n -> {_CHARACTER})[0], substr(p, length(f) + 1)), concat('&', p)))[0]"
)
_NAMED = (
    f"coalesce(transform(array(regexp_extract(p, {sql_pattern('^([A-Za-z][A-Za-z0-9]*);')}, 1)), n -> concat("
    f"try_element_at(try_element_at(from_json({sql_text(NAMED)}, 'map<string,map<string,string>>'), left(n, 1)), n), "
    f"substr(p, length(n) + 2)))[0], transform(array(regexp_extract(p, {sql_pattern('^(?:' + '|'.join(_BARE_NAMES) + ')')}, 0)), "
    f"n -> concat(try_element_at(from_json({sql_text(BARE)}, 'map<string,string>'), n), substr(p, length(n) + 1)))[0], "
    "concat('&', p))"
)
_COMMON = " ".join(
    f"WHEN startswith(p, '{name};') THEN concat({sql_text(char)}, substr(p, {len(name) + 2}))" for name, char in ENTITIES
)
DECODED_PIECE = (
    f"(p, i) -> CASE WHEN i = 0 THEN p {_COMMON} WHEN startswith(p, '#') THEN {_NUMERIC} "
    f"WHEN p RLIKE {sql_pattern('^[A-Za-z]')} THEN {_NAMED} ELSE concat('&', p) END"
)

# Escapes of HTML output, `&` first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&#34;"),
    ("'", "&#39;"),
)

# Markup that is never closed runs to the end of the text, as in browsers. So a match
# always consumes what it has looked at, and a text of any length is read in linear time.
HIDDEN_MARKUP = (
    r"(?is)<(?:script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)|!--.*?(?:-->|\z))"
)
TAG = r"<[A-Za-z/!?][^>]*(?:>|\z)"
SPACES = r"[ \t\n\x0b\f\r\xa0]+"


def trim_text(c: Column) -> Column:
    """Remove all Unicode white space at both ends (one linear pass, no regex)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left. `c` is evaluated once, which matters
    when it is a long chain of replacements."""
    return F.try_element_at(F.filter(F.array(trim_text(c)), lambda v: v != ""), F.lit(1))


def truncate_text(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def drop_hidden_markup(c: Column) -> Column:
    """Remove scripts, styles and comments."""
    return F.regexp_replace(c, HIDDEN_MARKUP, " ")


def decode_entities(c: Column) -> Column:
    """Decode all character references of HTML, one level, in one pass: the text is cut at
    each `&` and every piece is looked at once. `&nbsp;` becomes a space."""
    return F.array_join(F.call_function("transform", F.split(c, "&"), F.expr(DECODED_PIECE)), "")


def escape_html(c: Column) -> Column:
    for char, name in HTML_ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def strip_html(c: Column) -> Column:
    """Visible text: no hidden markup, tags to spaces, entities decoded, spaces squeezed."""
    visible = F.regexp_replace(drop_hidden_markup(c), TAG, " ")
    return trim_text(F.regexp_replace(decode_entities(visible), SPACES, " "))


def first_non_empty(*columns: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def contains_any(columns: list[Column], words: list[str]) -> Column:
    """True if one of the texts holds one of the words, ignoring case.

    Each text is lower-cased once; every word is a substring test.
    """
    lowered = [w.lower() for w in words]

    def found(text: Column) -> Column:
        return reduce(or_, (F.contains(text, F.lit(w)) for w in lowered), F.lit(False))

    texts = F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in columns))
    return F.exists(texts, found)
