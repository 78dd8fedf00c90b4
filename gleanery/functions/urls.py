"""URL parts, templates and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The generic URI split of RFC 3986, appendix B.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _group(c: Column, n: int) -> Column:
    return F.regexp_extract(c, URI, n)


def url_scheme(c: Column) -> Column:
    return F.lower(_group(c, 1))


def url_host(c: Column) -> Column:
    """Host with port and without user info; null if there is none."""
    return F.nullif(F.substring_index(_group(c, 2), "@", -1), F.lit(""))


def url_path(c: Column) -> Column:
    return F.coalesce(F.nullif(_group(c, 3), F.lit("")), F.lit("/"))


def url_query(c: Column) -> Column:
    return F.nullif(_group(c, 4), F.lit(""))


def url_parts(c: Column) -> Column:
    return F.struct(
        url_scheme(c).alias("scheme"),
        url_host(c).alias("host"),
        url_path(c).alias("path"),
        url_query(c).alias("query"),
    )


def request_path(path: Column, query: Column) -> Column:
    """The part of a URL that robots rules are matched against."""
    return F.when(query.isNull(), path).otherwise(F.concat(path, F.lit("?"), query))


def render_url_template(c: Column, on: Column) -> Column:
    """Fill `${page}` with 1 and `${date}` with the given date."""
    with_page = F.replace(c, F.lit("${page}"), F.lit("1"))
    return F.replace(with_page, F.lit("${date}"), F.date_format(on, "yyyy-MM-dd"))


def _encode(c: Column) -> Column:
    # Form encoding leaves `*` and escapes `~`; query encoding does the opposite.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def set_query_parameter(url: Column, name: Column, value: Column) -> Column:
    """The URL with one query parameter set or replaced and the query sorted by key."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)

    def pair(text: Column, i: Column) -> Column:
        value_text = F.when(F.contains(text, F.lit("=")), F.regexp_extract(text, r"^[^=]*=(.*)$", 1))
        return F.struct(
            F.try_url_decode(F.substring_index(text, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.coalesce(value_text, F.lit(""))).alias("v"),
        )

    # Pairs that cannot be decoded are dropped, as is the parameter being set.
    parsed = F.transform(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";"))), pair
    )
    kept = F.filter(parsed, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["k"] != name))
    added = F.array(F.struct(name.alias("k"), F.lit(0).alias("i"), value.alias("v")))
    pairs = F.array_sort(F.concat(kept, added))
    encoded = F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    return F.concat(base, F.lit("?"), F.array_join(encoded, "&"), fragment)


def url_with_page(url: Column, page: Column, enabled: Column, param: Column) -> Column:
    """The URL of one page: unchanged, `${page}` replaced, or the parameter set."""
    number = page.cast("string")
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), url)
        .when(F.contains(url, F.lit("${page}")), F.replace(url, F.lit("${page}"), number))
        .otherwise(set_query_parameter(url, param, number))
    )
