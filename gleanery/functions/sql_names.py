"""SQL names of the column functions, for use in `spark.sql`.

All are SQL functions, so the optimizer inlines them; none runs Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleanery.functions.collections import CATEGORY_WORDS, DEFAULT_USER_AGENT
from gleanery.functions.dates import DATE_REWRITES, DATE_SHAPES, ISO_START, ZONE_NAME, RFC3339
from gleanery.functions.registry import NO_CONTENT
from gleanery.functions.text import DECODED_PIECE, HIDDEN_MARKUP, SPACES, TAG, WHITE_SPACE, sql_pattern, sql_text
from gleanery.schemas import RESULT_TYPES


_WS = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE) + "'"
# Written in two pieces: `${...}` inside SQL text would be taken for a variable.
_PAGE = "concat('$', '{page}')"
_DATE = "concat('$', '{date}')"


def _trim(c: str) -> str:
    return f"btrim({c}, {_WS})"


def _strip(c: str) -> str:
    visible = f"regexp_replace(regexp_replace({c}, {sql_pattern(HIDDEN_MARKUP)}, ' '), {sql_pattern(TAG)}, ' ')"
    decoded = f"array_join(transform(split({visible}, '&'), {DECODED_PIECE}), '')"
    return _trim(f"regexp_replace({decoded}, {sql_pattern(SPACES)}, ' ')")


def _parse_date(c: str) -> str:
    text = _trim(c)
    for found, put in DATE_REWRITES:
        text = f"regexp_replace({text}, {sql_pattern(found)}, {sql_text(put)})"
    zone = f"regexp_extract(x, {sql_pattern(ZONE_NAME)}, 0)"
    capitals = (
        f"IF(x RLIKE {sql_pattern(ISO_START)}, upper(x), "
        f"concat(left(x, length(x) - length({zone})), upper({zone})))"
    )
    cases = " ".join(
        f'WHEN x RLIKE {sql_pattern(shape)} THEN try_to_timestamp(x, "{pattern}")'
        for shape, pattern in DATE_SHAPES
    )
    # A one-element array names the intermediate text, so it is written once.
    return f"transform(transform(array({text}), x -> {capitals}), x -> CASE {cases} END)[0]"


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(sql_text(v) for v in values)


def _encoded(c: str) -> str:
    return f"replace(replace(url_encode({c}), '*', '%2A'), '%7E', '~')"


_LINE = "substring_index(l, '#', 1)"
_COLON = "':'"
_AFTER_COLON = sql_pattern("(?s)^[^:]*:(.*)$")

_ROBOTS_LINES = (
    "filter(transform(split(body, '\\n'), (l, i) -> named_struct('pos', i, "
    f"'field', IF(contains({_LINE}, ':'), {_trim(f'lower(substring_index({_LINE}, {_COLON}, 1))')}, NULL), "
    f"'value', {_trim(f'regexp_extract({_LINE}, {_AFTER_COLON}, 1)')})), "
    "x -> x.field IS NOT NULL)"
)

# One-element arrays bind a value that is used several times.
_ROBOTS_GROUPS = (
    f"transform(array({_ROBOTS_LINES}), lines -> "
    "transform(array(filter(transform(lines, (x, i) -> IF(x.field = 'user-agent' AND "
    "(i = 0 OR get(lines, i - 1).field <> 'user-agent'), i, NULL)), s -> s IS NOT NULL)), "
    "starts -> transform(starts, (s, g) -> "
    "transform(array(slice(lines, s + 1, coalesce(get(starts, g + 1), size(lines)) - s)), "
    "part -> named_struct("
    "'agents', array_distinct(transform(filter(part, x -> x.field = 'user-agent' AND x.value <> ''), "
    "x -> lower(x.value))), "
    "'rules', transform(filter(part, x -> x.field IN ('allow', 'disallow') AND x.value <> ''), "
    "x -> named_struct('path', x.value, 'allow', x.field = 'allow', 'pos', x.pos))))[0]))[0])[0]"
)

_NORMALIZED_TYPES = ("text", "html", "json", "rss")

_CATEGORY_CASES = " ".join(
    f"WHEN {sql_text(old)} THEN {sql_text(new)}" for old, new in CATEGORY_WORDS.items()
)

SCALARS = {
    "glean_trim(c STRING) RETURNS STRING": _trim("c"),
    "glean_truncate(c STRING, n INT) RETURNS STRING": "left(c, n)",
    "glean_strip_html(c STRING) RETURNS STRING": _strip("c"),
    "glean_normalize(c STRING, kind STRING) RETURNS STRING": (
        f"CASE WHEN kind IN ({_in(_NORMALIZED_TYPES)}) THEN nullif({_trim('c')}, "
        f"IF(coalesce(c, '') = '', '', NULL)) ELSE c END"
    ),
    "glean_normalize_error(c STRING, kind STRING) RETURNS STRING": (
        f"CASE WHEN kind IN ({_in(_NORMALIZED_TYPES)}) AND coalesce(c, '') = '' "
        f"THEN {sql_text(NO_CONTENT)} END"
    ),
    "glean_format_date(t TIMESTAMP) RETURNS STRING": f'date_format(t, "{RFC3339}")',
    "glean_parse_date(c STRING) RETURNS TIMESTAMP": _parse_date("c"),
    "glean_default_timestamp(t TIMESTAMP, run_ts TIMESTAMP) RETURNS TIMESTAMP": "coalesce(t, run_ts)",
    "glean_categories(a ARRAY<STRING>) RETURNS ARRAY<STRING>": (
        f"transform(a, x -> CASE lower(x) {_CATEGORY_CASES} ELSE lower(x) END)"
    ),
    "glean_default_type(c STRING) RETURNS STRING": "coalesce(nullif(c, ''), 'other')",
    "glean_is_result_type(c STRING) RETURNS BOOLEAN": f"c IN ({_in(RESULT_TYPES)})",
    "glean_url_template(u STRING, d DATE) RETURNS STRING": (
        f"replace(replace(u, {_PAGE}, '1'), {_DATE}, date_format(d, 'yyyy-MM-dd'))"
    ),
    "glean_headers(h MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>": (
        f"map_concat(map('user-agent', {sql_text(DEFAULT_USER_AGENT)}), "
        "transform_keys(coalesce(h, map()), (k, v) -> lower(k)))"
    ),
    "glean_set_parameter(u STRING, name STRING, v STRING) RETURNS STRING": (
        "concat(regexp_extract(u, r'^([^?#]*)', 1), '?', array_join(transform(array_sort(concat("
        "filter(transform(filter(split(regexp_extract(u, r'^[^?#]*\\?([^#]*)', 1), '&'), "
        "p -> p <> '' AND NOT contains(p, ';')), (p, i) -> named_struct("
        "'k', try_url_decode(substring_index(p, '=', 1)), 'i', i, "
        "'v', try_url_decode(IF(contains(p, '='), regexp_extract(p, r'^[^=]*=(.*)$', 1), '')))), "
        "p -> p.k IS NOT NULL AND p.v IS NOT NULL AND p.k <> name), "
        "array(named_struct('k', name, 'i', 0, 'v', v)))), "
        f"p -> concat({_encoded('p.k')}, '=', {_encoded('p.v')})), '&'), "
        "regexp_extract(u, r'(#.*)$', 1))"
    ),
}

TABLES = {
    "glean_paginate(u STRING, enabled BOOLEAN, first INT, n INT, param STRING) "
    "RETURNS TABLE (page INT, url STRING)": (
        "SELECT p, CASE WHEN NOT coalesce(enabled, false) THEN u "
        f"WHEN contains(u, {_PAGE}) THEN replace(u, {_PAGE}, CAST(p AS STRING)) "
        "ELSE glean_set_parameter(u, param, CAST(p AS STRING)) END "
        "FROM explode(sequence(coalesce(first, 1), coalesce(first, 1) - 1 + "
        "IF(coalesce(enabled, false), greatest(n, 1), 1))) AS t(p)"
    ),
    "glean_parse_robots(body STRING) "
    "RETURNS TABLE (agent STRING, path STRING, allow BOOLEAN, pos INT)": (
        f"SELECT a, r.path, r.allow, r.pos FROM explode({_ROBOTS_GROUPS}) AS t(g), "
        "LATERAL explode(t.g.rules) AS x(r), LATERAL explode(t.g.agents) AS y(a)"
    ),
}


def register_all(spark: SparkSession) -> None:
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for signature, query in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {query}")
