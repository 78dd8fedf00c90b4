"""Growing arrays and maps, request headers and result types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.schemas import ITEM_FIELDS, RESULT_TYPES

DEFAULT_USER_AGENT = "gleanery/1.0"

# Whole-word category replacements.
CATEGORY_WORDS = {"tech": "technology", "prog": "programming"}


def append_values(array: Column, *values: Column) -> Column:
    """Append to a list column; an absent list starts empty, duplicates are kept."""
    return F.concat(F.coalesce(array, F.array().cast("array<string>")), F.array(*values))


def put_metadata(entries: Column, key: Column, value: Column) -> Column:
    """Set one key of a string map; an earlier value of the key is replaced."""
    kept = F.map_filter(
        F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: k != key
    )
    return F.map_concat(kept, F.create_map(key, value))


def effective_headers(headers: Column, user_agent: str = DEFAULT_USER_AGENT) -> Column:
    """Default User-Agent, overwritten by source headers whose names ignore case."""
    own = F.transform_keys(
        F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)
    )
    return F.when(F.map_contains_key(own, "user-agent"), own).otherwise(
        F.map_concat(F.create_map(F.lit("user-agent"), F.lit(user_agent)), own)
    )


def normalize_categories(array: Column, words: dict[str, str] | None = None) -> Column:
    """Lower-case every category, then replace whole words."""
    table = CATEGORY_WORDS if words is None else words
    if not table:
        return F.transform(array, F.lower)

    def replace_word(value: Column) -> Column:
        lowered = F.lower(value)
        chosen = None
        for old, new in table.items():
            hit = lowered == F.lit(old.lower())
            chosen = F.when(hit, new) if chosen is None else chosen.when(hit, new)
        return chosen.otherwise(lowered)

    return F.transform(array, replace_word)


def default_type(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("other"))


def is_result_type(c: Column) -> Column:
    return c.isin(*RESULT_TYPES)


def extra_fields(record: Column, mappings: Column) -> Column:
    """Mapped keys outside the item fields, under their target names."""
    targets = F.map_filter(
        mappings, lambda k, _: ~k.isin(*ITEM_FIELDS, "container")
    )
    found = F.transform_values(targets, lambda _, source: F.try_element_at(record, source))
    return F.map_filter(found, lambda _, v: v.isNotNull())
