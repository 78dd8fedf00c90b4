"""Global item filters."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.text import contains_any
from gleanery.session import written

# The sample keyword lists.
INCLUDE_WORDS = ("technology", "programming", "golang")
EXCLUDE_WORDS = ("advertisement", "sponsored")

# Bytes of keywords that are sent to the tasks at once.
KEYWORD_BYTES = 8 * 1024 * 1024
INCLUDED, EXCLUDED = 1, 2


def filter_date(
    items: DataFrame,
    after: datetime | str | None = None,
    before: datetime | str | None = None,
    column: str = "date",
) -> DataFrame:
    """Keep after <= date < before; an empty bound is open. Plain comparisons with
    literals, so they reach the scan."""

    def bound(value: datetime | str) -> Column:
        return F.lit(value).cast("timestamp")

    if after:
        items = items.filter(F.col(column) >= bound(after))
    if before:
        items = items.filter(F.col(column) < bound(before))
    return items


def filter_keywords(
    items: DataFrame,
    include: list[str] | tuple[str, ...] = (),
    exclude: list[str] | tuple[str, ...] = (),
    columns: tuple[str, ...] = ("title", "content"),
) -> DataFrame:
    """Keep rows that hold an include word (or the list is empty) and no exclude word.

    The verdict is made in a generator, not in a filter: a filter would be moved below
    the projection that computes the texts and compute them again for every test.
    """
    texts = [F.col(name) for name in columns]
    keep = F.lit(True)
    if include:
        keep = keep & contains_any(texts, list(include))
    if exclude:
        keep = keep & ~contains_any(texts, list(exclude))
    kept = items.select("*", F.explode(F.array(keep)).alias("_keep")).filter("_keep")
    return kept.drop("_keep")


def _word_finder(words: list[tuple[str, int]], found_by_all: int):
    """Which kinds of words (bits) stand in any of the texts of a row.

    All words are one automaton, so a text is read once whatever their number. Reading
    ends where a row is decided: an excluded word stands in it, or no kind is left to find.
    """
    every = found_by_all
    for _, kinds in words:
        every |= kinds

    def find(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, kinds in words:
            automaton.add_word(word, kinds)
        automaton.make_automaton()
        for columns in batches:
            masks = []
            for texts in zip(*(c.to_pylist() for c in columns)):
                mask = found_by_all
                for text in texts:
                    if mask == every or mask & EXCLUDED:
                        break
                    for _, kinds in automaton.iter(text or "") if words else ():
                        mask |= kinds
                        if mask == every or mask & EXCLUDED:
                            break
                masks.append(mask)
            yield pa.array(masks, pa.int32())

    return F.arrow_udf(find, "int")


def filter_keyword_tables(
    items: DataFrame,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    columns: tuple[str, ...] = ("title", "content"),
    word: str = "word",
    keyword_bytes: int = KEYWORD_BYTES,
) -> DataFrame:
    """`filter_keywords` with the words of two tables, of any number.

    The plan does not grow with the words: they are sent in blocks of `keyword_bytes`, and
    each block is one pass of an automaton over the texts, lower-cased once. No include table,
    or an empty one, includes everything. Null words count as absent, an empty word stands
    in every text.
    """
    kinds = [(t, k) for t, k in ((include, INCLUDED), (exclude, EXCLUDED)) if t is not None]
    if not kinds:
        return items
    listed = None
    for table, kind in kinds:
        own = table.select(F.lower(F.col(word)).alias("word"), F.lit(kind).alias("kind")).where("word is not null")
        listed = own if listed is None else listed.unionByName(own)
    listed = written(listed.groupBy("word").agg(F.bit_or("kind").alias("kinds")), "keywords")
    size, all_kinds, empty = listed.agg(
        F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0)),
        F.coalesce(F.bit_or("kinds"), F.lit(0)),
        F.coalesce(F.bit_or(F.when(F.col("word") == "", F.col("kinds"))), F.lit(0)),
    ).first()
    texts = [f"_text{i}" for i in range(len(columns))]
    rows = items.select("*", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(t) for c, t in zip(columns, texts)))
    mask = F.lit(empty)
    blocks = size // keyword_bytes + 1
    block = F.pmod(F.xxhash64("word"), F.lit(blocks))
    for k in range(blocks):
        words = [(r["word"], r["kinds"]) for r in listed.where((block == k) & (F.col("word") != "")).collect()]
        rows = rows.withColumn(f"_found{k}", _word_finder(words, 0)(*texts))
        mask = mask.bitwiseOR(F.col(f"_found{k}"))
    keep = mask.bitwiseAND(EXCLUDED) == 0
    if all_kinds & INCLUDED:
        keep = keep & (mask.bitwiseAND(INCLUDED) != 0)
    return rows.where(keep).select(*items.columns)
