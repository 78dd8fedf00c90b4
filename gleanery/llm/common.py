"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def packed(rows: DataFrame) -> Column:
    """All columns as one struct, so that no working column can clash with them."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in rows.columns))


def row_identity(rows: DataFrame) -> Column:
    """A digest of the whole row: rows with the same digest are repeated rows."""
    return F.xxhash64(F.to_json(packed(rows), {"ignoreNullFields": "false"}))


def fold(doc_id: Column) -> Column:
    """Rows of fold 0 are held out from all training; a null id is fold 0 too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def utf8_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer, bounds


def given_back(batches: Iterable) -> Iterator:
    """The batches one by one. Behind each, Arrow's unused memory goes back to the system; a
    worker, which serves many stages, would else keep the most it ever held."""
    import pyarrow as pa

    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def runs_of_texts(bounds: np.ndarray, max_bytes: int) -> Iterable[tuple[int, int]]:
    """Cut consecutive texts into runs of about `max_bytes`; a longer text is its own run."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), len(bounds) - 1)
        yield first, last
        first = last
