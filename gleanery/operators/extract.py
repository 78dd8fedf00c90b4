"""Fetched bodies to items.

`parse_results` reads every parser type in one pass over the bodies: the parser is
chosen per row by a `when` chain, so the wide body column is scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.collections import extra_fields
from gleanery.functions.elements import LEAF, page_items, parse_selector
from gleanery.functions.registry import Registry
from gleanery.functions.selectors import all_matches, clean_value, first_match, matched_fields
from gleanery.functions.text import drop_hidden_markup, strip_html, trim_text
from gleanery.operators.joins import enrich_with_source
from gleanery.operators.lookup import lookup_join
from gleanery.schemas import ITEM, ITEM_FIELDS
from gleanery.session import written
from gleanery.sources.registry import extraction_rules

RECORDS = "array<map<string,string>>"
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def _are_leaves(selectors: dict[str, str]) -> bool:
    """Whether all selectors are lists of leaf forms; others are read here once, so that
    an unreadable one is an error before any page is."""
    if all(re.match(LEAF, s) and s.strip() for listed in selectors.values() for s in listed.split(",")):
        return True
    for listed in selectors.values():
        parse_selector(listed)
    return False


def _cleaner(field: str):
    return lambda value: clean_value(field, drop_hidden_markup(value))


def _candidates(pages: DataFrame, selectors: dict[str, str], body: str, every: bool) -> DataFrame:
    """The page's candidates of each field, as the map `_found`."""
    found = page_items(F.col(body), _mapping_literal(selectors), every)
    return pages.withColumn("_found", F.try_element_at(found["items"], F.lit(1)))


def extract_html(pages: DataFrame, selectors: dict[str, str], body: str = "html") -> DataFrame:
    """One item per page from literal selectors; a field replaces a column of its name.

    Lists of leaf forms are patterns, all others are met on the elements of the page.
    """
    if not _are_leaves(selectors):
        kept = [c for c in pages.columns if c != body and c not in selectors]
        first = [_first_value(F.lit(f), F.col("_found")[f]).alias(f) for f in selectors]
        return _candidates(pages, selectors, body, False).select(*kept, *first)
    visible = pages.withColumn("_markup", drop_hidden_markup(F.col(body)))
    fields = [first_match(f, F.col("_markup"), s).alias(f) for f, s in selectors.items()]
    kept = [c for c in pages.columns if c != body and c not in selectors]
    return visible.select(*kept, *fields)


def extract_multi(pages: DataFrame, selectors: dict[str, str], body: str = "html") -> DataFrame:
    """List fields (categories, tags, images, links); duplicates are kept."""
    if not _are_leaves(selectors):
        kept = [c for c in pages.columns if c != body and c not in selectors]
        lists = [
            F.filter(
                F.transform(F.coalesce(F.col("_found")[f], F.array()), _cleaner(f)),
                lambda v: v != "",
            ).alias(f)
            for f in selectors
        ]
        return _candidates(pages, selectors, body, True).select(*kept, *lists)
    visible = pages.withColumn("_markup", drop_hidden_markup(F.col(body)))
    fields = [all_matches(f, F.col("_markup"), s).alias(f) for f, s in selectors.items()]
    kept = [c for c in pages.columns if c != body and c not in selectors]
    return visible.select(*kept, *fields)


class _Containers(HTMLParser):
    """Item fields found inside each match of a container, nesting respected.

    A selector is (tag, attribute, value, wanted attribute); None means any. An
    element ends at its own end tag or when its parent ends, so unclosed elements
    do not swallow what follows the parent.
    """

    VOID = frozenset(
        "area base br col embed hr img input link meta source track wbr".split()
    )

    def __init__(self, container: tuple, fields: dict[str, tuple]) -> None:
        super().__init__(convert_charrefs=True)
        self.container, self.fields = container, fields
        self.items: list[dict[str, str]] = []
        self.stack: list[tuple[str, list[tuple[dict, str]], bool]] = []
        self.open_items: list[dict[str, str]] = []
        self.open_texts: list[tuple[dict, str, list[str]]] = []

    @staticmethod
    def matches(selector: tuple, tag: str, attrs: dict[str, str]) -> bool:
        want_tag, name, value, _ = selector
        if want_tag and want_tag != tag:
            return False
        if name is None:
            return True
        have = attrs.get(name)
        if have is None:
            return False
        return value is None or (value in have.split() if name == "class" else value == have)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        opened: list[tuple[dict, str]] = []
        is_item = self.matches(self.container, tag, values)
        if self.open_items:
            item = self.open_items[-1]
            for field, selector in self.fields.items():
                if field in item or not self.matches(selector, tag, values):
                    continue
                if selector[3]:
                    if values.get(selector[3], "").strip():
                        item[field] = values[selector[3]].strip()
                elif not any(i is item and f == field for i, f, _ in self.open_texts):
                    self.open_texts.append((item, field, []))
                    opened.append((item, field))
        if is_item:
            item = {}
            self.items.append(item)
            self.open_items.append(item)
        if tag in self.VOID:
            self.close(opened, is_item)
        else:
            self.stack.append((tag, opened, is_item))

    def handle_endtag(self, tag: str) -> None:
        if any(open_tag == tag for open_tag, _, _ in self.stack):
            while True:
                open_tag, opened, is_item = self.stack.pop()
                self.close(opened, is_item)
                if open_tag == tag:
                    return

    def close(self, opened: list, is_item: bool) -> None:
        for item, field in opened:
            for i, (i_item, i_field, parts) in enumerate(self.open_texts):
                if i_item is item and i_field == field:
                    text = " ".join("".join(parts).split())
                    if text and field not in item:
                        item[field] = text
                    del self.open_texts[i]
                    break
        if is_item:
            self.open_items.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        for _, _, parts in self.open_texts:
            parts.append(data)

    def close_all(self) -> None:
        while self.stack:
            _, opened, is_item = self.stack.pop()
            self.close(opened, is_item)


def _parse_selector(field: str, selector: str) -> tuple:
    element, _, attribute = selector.strip().partition("@")
    wanted = attribute or {"url": "href"}.get(field)
    for mark, name in ((".", "class"), ("#", "id")):
        if mark in element:
            tag, _, value = element.partition(mark)
            return tag or None, name, value, wanted
    if "[" in element:
        tag, _, rest = element.rstrip("]").partition("[")
        name, _, value = rest.partition("=")
        return tag or None, name.strip(), value.strip(" \"'") or None, wanted
    return element or None, None, None, wanted


def extract_html_items(
    pages: DataFrame, container: str, selectors: dict[str, str], key: str = "page_id", body: str = "html"
) -> DataFrame:
    """One item (key, item_no, fields) per container match, nesting respected.

    Pages stream through as Arrow batches, and only the key and the body are sent; the
    keys stay Arrow values. Filter the pages first; no filter passes this operator.
    """
    parsed_container = _parse_selector("", container)
    parsed_fields = {f: _parse_selector(f, s) for f, s in selectors.items()}
    names = list(selectors)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, values = [], [], []
            for place, html in enumerate(batch.column(body).to_pylist()):
                parser = _Containers(parsed_container, parsed_fields)
                parser.feed(html or "")
                parser.close_all()
                places += [place] * len(parser.items)
                numbers += range(len(parser.items))
                values += parser.items
            keys = batch.column(key).take(pa.array(places, pa.int64()))
            fields = [pa.array([item.get(f) for item in values], pa.string()) for f in names]
            columns = [keys, pa.array(numbers, pa.int32()), *fields]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "item_no", *names])

    key_type = pages.schema[key].dataType.simpleString()
    fields = ", ".join(f"{f} string" for f in names)
    return pages.select(key, body).mapInArrow(read, f"{key} {key_type}, item_no int, {fields}")


def _item(values: dict[str, Column], extra: Column) -> Column:
    return F.struct(*(values[f].alias(f) for f in ITEM_FIELDS), extra.alias("extra"))


def _items_from_records(records: Column, mappings: Column) -> Column:
    """Records (key -> text) to items; `mappings` is target field -> record key."""

    def one(record: Column) -> Column:
        values = {f: F.try_element_at(record, F.try_element_at(mappings, F.lit(f))) for f in ITEM_FIELDS}
        return _item(values, extra_fields(record, mappings))

    return F.transform(records, one)


# A path that VARIANT reads: names joined by points, places and quoted names in brackets.
PATH = r"""^[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*|\[\d+\]|\['[^'\]]+'\])*$"""


def _at_path(value: Column, path: Column, kind: str) -> Column:
    """The value under a key of that very name, else at the path that it spells."""
    named = F.concat(F.lit("$['"), path, F.lit("']"))
    under = F.when(~F.contains(path, F.lit("'")), F.call_function("try_variant_get", value, named, F.lit(kind)))
    spelt = F.concat(F.lit("$."), path)
    return F.coalesce(
        under, F.when(F.rlike(path, F.lit(PATH)), F.call_function("try_variant_get", value, spelt, F.lit(kind)))
    )


def variant_records(body: Column, mappings: Column) -> Column:
    """The objects of the container as maps of mapped key or path to text.

    The container is an array, of which anything but objects is left out, or one object.
    """
    container = F.try_element_at(mappings, F.lit("container"))
    document = F.try_parse_json(body)
    found = F.when(container.isNull(), document).otherwise(_at_path(document, container, "variant"))
    as_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    listed = F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.when(as_object(found).isNotNull(), F.array(found)))
    keys = F.array_distinct(F.map_values(F.map_filter(mappings, lambda k, _: k != "container")))
    return F.transform(
        F.filter(listed, lambda v: as_object(v).isNotNull()),
        lambda v: F.map_from_arrays(keys, F.transform(keys, lambda k: _at_path(v, k, "string"))),
    )


def json_records(body: Column, mappings: Column) -> Column:
    """The objects of the container path (or of the whole document) as string maps.

    Arrays of objects under plain keys are read at once. Mappings with a path, and bodies of
    any other shape, are read as VARIANT.
    """
    container = F.try_element_at(mappings, F.lit("container"))
    path = F.when(container.isNull(), "$").otherwise(F.concat(F.lit("$."), container))
    at_once = F.from_json(F.call_function("get_json_object", body, path), RECORDS)
    keys = F.map_values(F.map_filter(mappings, lambda k, _: k != "container"))
    plain = ~F.exists(keys, lambda k: F.rlike(k, F.lit(r"[.\[]")))
    return F.coalesce(F.when(plain, at_once), variant_records(body, mappings))


# Element name that the records of a source get before they are read: a schema is fixed,
# while the name of the repeated element is the source's own.
ROW_ELEMENT = "glean-row"


def xml_records(body: Column, mappings: Column, row_element: str = "item") -> Column:
    """The repeated child elements named by the container (default: `row_element`)."""
    container = F.coalesce(F.try_element_at(mappings, F.lit("container")), F.lit(row_element))
    tag = F.concat(F.lit(r"<(/?)\Q"), container, F.lit(r"\E(?=[\s/>])"))
    named = F.call_function("regexp_replace", body, tag, F.lit(f"<$1{ROW_ELEMENT}"))
    return F.from_xml(named, f"`{ROW_ELEMENT}` {RECORDS}", XML_OPTIONS)[ROW_ELEMENT]


def rss_records(body: Column) -> Column:
    schema = f"channel struct<item: {RECORDS}>"
    return F.from_xml(body, schema, XML_OPTIONS)["channel"]["item"]


def html_records(body: Column, patterns: Column) -> Column:
    """Field values of the page as a map, from compiled patterns."""
    return F.transform(F.array(drop_hidden_markup(body)), lambda markup: matched_fields(markup, patterns))


def _first_value(field: Column, candidates: Column) -> Column:
    """The first candidate that is not blank; content keeps its markup."""
    cleaned = F.transform(
        candidates,
        lambda v: F.when(field == "content", trim_text(drop_hidden_markup(v))).otherwise(strip_html(v)),
    )
    return F.try_element_at(F.filter(cleaned, lambda v: v != ""), F.lit(1))


def element_records(items: Column) -> Column:
    """Items of `page_items` as records."""
    return F.transform(items, lambda item: F.transform_values(item, _first_value))


def _mapping_literal(mappings: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mappings.items() for x in pair))


def _explode_items(bodies: DataFrame, items: Column, body: str) -> DataFrame:
    kept = [c for c in bodies.columns if c != body]
    return bodies.select(*kept, F.posexplode(items).alias("item_no", "_item")).select(
        *kept, "item_no", "_item.*"
    )


def extract_json(bodies: DataFrame, mappings: dict[str, str], body: str = "body") -> DataFrame:
    targets = _mapping_literal(mappings)
    return _explode_items(
        bodies, _items_from_records(json_records(F.col(body), targets), targets), body
    )


def extract_xml(
    bodies: DataFrame, mappings: dict[str, str], row_element: str = "item", body: str = "body"
) -> DataFrame:
    targets = _mapping_literal(mappings)
    records = xml_records(F.col(body), targets, row_element)
    return _explode_items(bodies, _items_from_records(records, targets), body)


def extract_rss(bodies: DataFrame, mappings: dict[str, str], body: str = "body") -> DataFrame:
    targets = _mapping_literal(mappings)
    return _explode_items(bodies, _items_from_records(rss_records(F.col(body)), targets), body)


def parse_results(
    jobs: DataFrame, sources: DataFrame, xml_row_element: str = "item", registry: Registry | None = None
) -> DataFrame:
    """One row per body: its `items` array, or an `error`. A body whose source is not among
    `sources`, or whose source has a selector that cannot be read, is an error too.

    `jobs` has source_id and body; `sources` chooses parser, selectors and mappings.
    A job that already carries an `error` keeps it and is not read. The rules are made of
    the sources once and written. Where one of them has containers or combinators, the
    bodies of its source go through Arrow once, as the elements of a page; all others stay
    where they are.
    """
    rules = extraction_rules(sources).withColumnsRenamed(
        {"parser": "_parser", "patterns": "_patterns", "selectors": "_selectors", "mappings": "_mappings"}
    ).withColumn("_known", F.lit(True))
    rules = written(rules, "rules")
    parser, body, mappings = F.col("_parser"), F.col("body"), F.col("_mappings")
    readers = {
        "html": html_records(body, F.col("_patterns")),
        "json": json_records(body, mappings),
        "xml": xml_records(body, mappings, xml_row_element),
        "rss": rss_records(body),
    }
    if registry:
        readers |= {name: read(body, mappings) for name, read in registry.readers.items()}
    earlier = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    joined = lookup_join(jobs, rules, "source_id", "left")
    unreadable_selector = F.lit(None).cast("string")
    if not rules.where("_selectors is not null").isEmpty():
        markup = F.when(F.col("_selectors").isNotNull() & earlier.isNull(), body)
        joined = joined.withColumn("_found", page_items(markup, F.col("_selectors")))
        unreadable_selector = F.col("_found.error")
        by_elements = F.when(F.col("_selectors").isNotNull(), element_records(F.col("_found.items")))
        if not (registry and "html" in registry.readers):
            readers["html"] = by_elements.otherwise(readers["html"])
    records = F.when(earlier.isNotNull(), F.lit(None).cast(RECORDS))
    for name, read in readers.items():
        records = records.when(parser == name, read)
    known = F.coalesce(parser.isin(*readers), F.lit(False))
    unknown = F.when(
        F.col("_known").isNull(),
        F.concat(F.lit("unknown source: "), F.coalesce(F.col("source_id").cast("string"), F.lit(""))),
    )
    no_parser = F.when(
        ~known, F.concat(F.lit("no parser available for type: "), F.coalesce(parser, F.lit("")))
    )
    kept = [c for c in jobs.columns if c not in ("body", "error")]
    read_once = joined.select(
        *kept,
        parser.alias("extracted_by"),
        _items_from_records(records, mappings).alias("items"),
        F.coalesce(earlier, unknown, no_parser, unreadable_selector).alias("_error"),
    )
    unreadable = F.when(
        F.col("items").isNull(),
        F.concat(F.lit("unreadable body for parser: "), F.col("extracted_by")),
    )
    return read_once.withColumn("error", F.coalesce("_error", unreadable)).drop("_error")


def dispatch_extract(
    jobs: DataFrame,
    sources: DataFrame,
    registry: Registry | None = None,
    xml_row_element: str = "item",
) -> DataFrame:
    """Items and error rows of all bodies, each read by its source's parser.

    An item without an address of its own has that of its fetch.

    The built-in parsers and all added by `register_reader` share one pass. Every job
    added by `register_extractor` gets the bodies of its type as a pass of its own.
    """
    custom = registry.extractors if registry else {}
    parser = F.coalesce(F.nullif("parser", F.lit("")), "type")
    common = sources
    if custom:
        common = sources.filter(~F.coalesce(parser.isin(*custom), F.lit(False)))
        own_types = sources.filter(parser.isin(*custom)).select("source_id")
        results = parse_results(jobs.join(own_types, "source_id", "left_anti"), common, xml_row_element, registry)
    else:
        results = parse_results(jobs, common, xml_row_element, registry)
    kept = [c for c in results.columns if c not in ("items", "error")]
    carried = [c for c in kept if c != "url"]
    one_error = F.array(F.lit(None).cast(f"struct<{ITEM}>"))
    rows = F.when(F.col("error").isNotNull(), one_error).otherwise(F.col("items"))
    fields = [F.col(f"_item.{f}") for f in (*ITEM_FIELDS, "extra") if f != "url"]
    item_url = F.coalesce(F.col("_item.url"), F.col("url")) if "url" in kept else F.col("_item.url")
    out = results.select(*kept, "error", F.posexplode(rows).alias("item_no", "_item")).select(
        *carried, "item_no", item_url.alias("url"), *fields, "error"
    )
    for name, job in custom.items():
        own = jobs.join(sources.filter(parser == name).select("source_id"), "source_id", "left_semi")
        out = out.unionByName(job(own), allowMissingColumns=True)
    return out


def stamp_items(items: DataFrame, sources: DataFrame, run_ts: Column) -> DataFrame:
    """Source name and address, parse time and extractor on each item.

    `fetched_at` and `extracted_by` travel with the row since the fetch.
    """
    names = sources.select(
        "source_id", F.col("name").alias("source_name"), F.col("url").alias("source_url")
    )
    return enrich_with_source(items, names).withColumn("parsed_at", run_ts)
