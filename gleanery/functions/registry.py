"""Registered normalizers and extractors, by content type and parser type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.text import trim_text

Normalizer = Callable[[Column], Column]
Extractor = Callable[[DataFrame], DataFrame]
# From the columns body and mappings (target field -> record key) to the records of a body,
# array<map<string,string>>; null for a body that cannot be read.
Reader = Callable[[Column, Column], Column]

NO_CONTENT = "no content to normalize"


class Registry:
    """Functions chosen by a type name; registering a name again replaces it."""

    def __init__(self) -> None:
        self.normalizers: dict[str, Normalizer] = {}
        self.extractors: dict[str, Extractor] = {}
        self.readers: dict[str, Reader] = {}
        for content_type in ("text", "html", "json", "rss"):
            self.register_normalizer(content_type, trim_text)

    def register_normalizer(self, content_type: str, fn: Normalizer) -> None:
        self.normalizers[content_type] = fn

    def register_extractor(self, parser: str, job: Extractor) -> None:
        """A job over the bodies of a type, as a pass of its own."""
        self.extractors[parser] = job

    def register_reader(self, parser: str, reader: Reader) -> None:
        """A reader on columns, chosen per row in the one pass over all bodies; an Arrow
        function may be behind it. It replaces a built-in reader of its name."""
        self.readers[parser] = reader

    def normalized(self, content: Column, content_type: Column) -> Column:
        """One `when` chain; a type nobody registered keeps its content."""
        chain = None
        for name, fn in self.normalizers.items():
            hit, value = content_type == F.lit(name), fn(content)
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return content if chain is None else chain.otherwise(content)

    def normalize_error(self, content: Column, content_type: Column) -> Column:
        missing = content_type.isin(*self.normalizers) & (F.coalesce(content, F.lit("")) == "")
        return F.when(missing, F.lit(NO_CONTENT))
