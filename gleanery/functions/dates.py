"""Dates in and out of text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from gleanery.functions.text import trim_text

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"

# Shape of the text (in capitals but for the month) -> pattern that reads it.
# Parts in brackets may be absent; a time without a zone is UTC, as the session is.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (
        r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$",
        "yyyy-MM-dd['T'][ ]HH:mm[:ss][.SSSSSSSSS][XXX][XX]",
    ),
    (
        r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})?( [A-Z]{1,4})?$",
        "d MMM yyyy HH:mm[:ss][ z]",
    ),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})? [+-]\d{4}$", "d MMM yyyy HH:mm[:ss] Z"),
)
# Fixed values, used in order: the weekday goes, two-digit years become those from 1950
# to 2049, and two other names of UTC become that one.
DATE_REWRITES = (
    (r"^[A-Za-z]{3,9},\s*", ""),
    (r"^(\d{1,2} [A-Za-z]{3}) ([0-4]\d) (?=\d{2}:)", "$1 20$2 "),
    (r"^(\d{1,2} [A-Za-z]{3}) ([5-9]\d) (?=\d{2}:)", "$1 19$2 "),
    (r" (?i:ut|z)$", " UTC"),
)
# What is written in capitals: an ISO text as a whole, else the zone name at its end.
ISO_START, ZONE_NAME = r"^\d{4}-", r"[A-Za-z]{1,4}$"


def parse_date(c: Column) -> Column:
    """ISO 8601, date-only and RFC 822 text to a timestamp; unreadable text to null.

    Seconds, fraction and zone may be absent, a space may stand for the T, years may have
    two digits and zones small letters. The shape test picks one pattern, so a row is
    parsed once and the parser does not raise for every pattern that does not fit.
    """
    text = trim_text(c)
    for found, put in DATE_REWRITES:
        text = F.regexp_replace(text, found, put)
    zone = F.regexp_extract(text, ZONE_NAME, 0)
    rest = F.left(text, F.length(text) - F.length(zone))
    text = F.when(text.rlike(ISO_START), F.upper(text)).otherwise(F.concat(rest, F.upper(zone)))
    (shape, pattern), *others = DATE_SHAPES
    chosen = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    for shape, pattern in others:
        chosen = chosen.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    return chosen


def format_date(c: Column) -> Column:
    return F.date_format(c, RFC3339)


def default_timestamp(c: Column, run_ts: datetime | Column) -> Column:
    return F.coalesce(c, run_ts if isinstance(run_ts, Column) else F.lit(run_ts))
