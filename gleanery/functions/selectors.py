"""Leaf CSS selectors as regular expressions.

A selector (`tag`, `tag.class`, `.class`, `#id`, `[attr]`, `tag[attr=value]`, each
with an optional `@attribute`) becomes a pattern through string expressions. A
literal selector folds to a literal pattern, which is compiled once per task; a
selector held in a source row becomes a pattern column of the small sources table.
Elements nested in an element of the same tag need `extract_html_items`. An element
that is never closed runs to the end of the page, which keeps the search linear.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions.text import blank_to_null, strip_html, trim_text

# Elements without content.
VOID = "(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)"

# Captured group that holds an element's inner markup or an attribute value.
VALUE_GROUP = 2


def _extract(markup: Column, pattern: Column) -> Column:
    # The Python wrapper takes patterns as text only; the function takes columns too.
    return F.call_function("regexp_extract", markup, pattern, F.lit(VALUE_GROUP))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def selector_pattern(selector: Column, attribute: Column | None = None) -> Column:
    """Pattern of one selector; `attribute` is used when it names no `@attribute`."""
    text = trim_text(selector)
    element = F.substring_index(text, "@", 1)
    own_attribute = F.nullif(F.regexp_extract(text, r"@([\w:-]+)$", 1), F.lit(""))
    wanted = own_attribute if attribute is None else F.coalesce(own_attribute, attribute)

    tag = F.regexp_extract(element, r"^([A-Za-z][A-Za-z0-9-]*)", 1)
    css_class = F.regexp_extract(element, r"^[\w-]*\.([\w-]+)", 1)
    css_id = F.regexp_extract(element, r"^[\w-]*#([\w-]+)", 1)
    attr = F.regexp_extract(element, r"\[\s*([\w:-]+)", 1)
    attr_value = F.regexp_extract(element, r"""\[\s*[\w:-]+\s*=\s*["']?([^"'\]]*)["']?\s*\]""", 1)

    tag_pattern = F.when(tag == "", F.lit("[a-z][a-z0-9-]*")).otherwise(tag)
    cls = _quoted(css_class)
    class_test = F.when(css_class == "", "").otherwise(
        F.concat(
            F.lit(r'(?=[^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?'), cls, F.lit(r'(?:\s[^"]*)?"'),
            F.lit(r"|'(?:[^']*\s)?"), cls, F.lit(r"(?:\s[^']*)?'"),
            F.lit("|"), cls, F.lit(r"[\s>/]))"),
        )
    )
    id_test = F.when(css_id == "", "").otherwise(
        F.concat(F.lit(r"""(?=[^>]*\sid\s*=\s*["']?"""), _quoted(css_id), F.lit(r"""["'\s/>])"""))
    )
    attr_test = (
        F.when(attr == "", "")
        .when(
            F.contains(element, F.lit("=")),
            F.concat(
                F.lit(r"(?=[^>]*\s"), _quoted(attr), F.lit(r"""\s*=\s*["']?"""),
                _quoted(attr_value), F.lit(r"""["'\s/>])"""),
            ),
        )
        .otherwise(F.concat(F.lit(r"(?=[^>]*\s"), _quoted(attr), F.lit(r"[\s=/>])")))
    )
    opening = F.concat(
        F.lit("("), tag_pattern, F.lit(r")(?=[\s/>])"), class_test, id_test, attr_test
    )
    return F.when(
        wanted.isNotNull(),
        F.concat(
            F.lit("(?is)<"), opening, F.lit(r"[^>]*?\s"), _quoted(wanted),
            F.lit(r"""\s*=\s*["']?((?<=")[^">]*|(?<=')[^'>]*|[^\s"'>]+)"""),
        ),
    ).otherwise(
        F.concat(F.lit(rf"(?is)<(?!{VOID}[\s/>])"), opening, F.lit(r"[^>]*>(.*?)(?:</\1\s*>|\z)"))
    )


# Attribute read for a field whose selector names none. URLs are
# addresses, not link texts.
FIELD_ATTRIBUTES = {"url": "href", "links": "href", "images": "src"}


def field_attribute(field: str) -> Column:
    return F.lit(FIELD_ATTRIBUTES.get(field)).cast("string")


def compiled_patterns(selectors: Column) -> Column:
    """Map of field -> comma list of selectors to map of field -> patterns, in order
    of preference."""

    def compile_one(field: Column, listed: Column) -> Column:
        attribute = F.when(field.isin("url", "links"), "href").when(field == "images", "src")
        return F.transform(F.split(listed, ","), lambda s: selector_pattern(s, attribute))

    return F.transform_values(selectors, compile_one)


def clean_value(field: str, value: Column) -> Column:
    """Content keeps its markup for the normalizer; other fields become plain text."""
    return trim_text(value) if field == "content" else strip_html(value)


def first_match(field: str, markup: Column, selector: str) -> Column:
    """First non-blank value over a literal comma list of selectors."""
    candidates = [
        blank_to_null(
            clean_value(
                field, _extract(markup, selector_pattern(F.lit(s), field_attribute(field)))
            )
        )
        for s in selector.split(",")
    ]
    return F.coalesce(*candidates)


def matched_fields(markup: Column, patterns: Column) -> Column:
    """Map of field -> first non-blank value, over a map of compiled patterns."""

    def value(field: Column, candidates: Column) -> Column:
        found = F.transform(candidates, lambda p: _extract(markup, p))
        cleaned = F.transform(
            found, lambda v: F.when(field == "content", trim_text(v)).otherwise(strip_html(v))
        )
        return F.try_element_at(F.filter(cleaned, lambda v: v != ""), F.lit(1))

    return F.transform_values(patterns, value)


def all_matches(field: str, markup: Column, selector: str) -> Column:
    """Every value of every selector of the list, duplicates kept, blanks dropped."""
    found = [
        F.transform(
            F.regexp_extract_all(
                markup, selector_pattern(F.lit(s), field_attribute(field)), F.lit(VALUE_GROUP)
            ),
            lambda v: clean_value(field, v),
        )
        for s in selector.split(",")
    ]
    return F.filter(F.concat(*found), lambda v: v != "")
