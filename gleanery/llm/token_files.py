"""Token-id files with a minimal perfect hash index.

A token store is a folder of two Parquet tables:

* ``payload``: blocks of raw little-endian ids (16 bits where the vocabulary allows it,
  else 32) in ascending document order. A block holds whole documents, up to
  BLOCK_IDS ids or one longer document. Columns: ``shard`` (a range of document ids),
  ``block``, ``first`` (ids of the shard before the block), ``width`` (bytes per id),
  ``docs`` (id and number of ids of each document) and ``ids``.
* ``index``: one row per part of the keys. ``seeds`` and the slot arrays
  (``fingerprint``, ``shard``, ``block``, ``position``) are a minimal perfect hash by
  hash-and-displace: n keys fill n slots, a key is found by one seed and one slot, and
  the stored fingerprint rejects keys that were never put in.

A key is read where the index says: its block is fetched by (shard, block), and its ids are
those at its position. Keys are document ids. Repeated ids stand next to each other and share one key, that of
their first record. Records with a null id come first and have no key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import given_back, table
from gleanery.llm.word_codes import encoded_runs, word_encoder
from gleanery.session import scratch_dir, written

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 16
# Keys per part of the index.
PART_KEYS = 50_000

class Encoder:
    """Raw ids of texts, with the end id, in as few bytes an id as the vocabulary allows."""

    def __init__(self, path: str):
        self.path = path
        self.width = word_encoder(path).width

    def encode(self, texts) -> Iterator[bytes]:
        """For each text of a list or an Arrow array; a null text has the end id only."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for _, ids in encoded_runs(texts, self.path):
            yield np.append(ids, np.uint32(END_ID)).astype(f"<u{self.width}").tobytes()


PAYLOAD = (
    "shard int, block int, first long, width int, docs array<struct<doc_id:long,n:long>>, ids binary"
)


def _block(shard, block, first, width, docs, parts):
    listed = [{"doc_id": i, "n": n} for i, n in docs]
    return (shard, block, first, width, listed, b"".join(parts))


def _payload_writer(path: str):
    kind = pa.schema(
        [
            ("shard", pa.int32()),
            ("block", pa.int32()),
            ("first", pa.int64()),
            ("width", pa.int32()),
            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))),
            ("ids", pa.binary()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path)
        shard = TaskContext.get().partitionId()
        block, first, docs, parts, held = 0, 0, [], [], 0
        done: list[tuple] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in done], kind)

        for rows in given_back(batches):
            keys = rows.column("doc_id").to_pylist()
            for key, raw in zip(keys, own.encode(rows.column("text"))):
                n = len(raw) // own.width
                if docs and held + n > BLOCK_IDS:
                    done.append(_block(shard, block, first, own.width, docs, parts))
                    size += held * own.width
                    block, first, docs, parts, held = block + 1, first + held, [], [], 0
                    if size > 8 << 20:
                        yield batch()
                        done, size = [], 0
                docs.append((key, n))
                parts.append(raw)
                held += n
        if docs:
            done.append(_block(shard, block, first, own.width, docs, parts))
        if done:
            yield batch()

    return encode


def write_payload(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encode all documents and write their ids in ascending order of doc_id, nulls first.

    Documents are dealt out by ranges of (doc_id, digest of the text, row), so that a shard
    comes before the next one, and sorted inside. The number of shards follows
    ``spark.sql.shuffle.partitions`` and the advisory partition size. A null or empty text
    has the end id only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # cuts a run of repeated rows
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text"), "row")
    ordered = dealt.sortWithinPartitions("doc_id", "text").drop("row")
    ids = ordered.mapInArrow(_payload_writer(vocabulary), PAYLOAD)
    ids.write.option("compression", "zstd").parquet(path)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of the keys (multiply and shift, wrapping)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key. A negative seed names the slot of a bucket with one key."""
    place = _hash(keys, 2)
    step = _hash(keys, 3) | np.uint64(1)
    mixed = (place + seeds.astype(np.int64).view(np.uint64) * step) >> np.uint64(16)
    return np.where(seeds < 0, -seeds - 1, (mixed % np.uint64(n)).astype(np.int64))


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct keys, one seed per bucket of about four."""
    n = len(keys)
    buckets = n // 4 + 1
    bucket = (_hash(keys, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(count) - count
    seeds = np.zeros(buckets, np.int64)
    taken = np.zeros(n, bool)
    trial = np.arange(0, 64, dtype=np.uint64)
    place, step = _hash(keys, 2), _hash(keys, 3) | np.uint64(1)
    size = np.uint64(n)
    by_size = np.argsort(-count, kind="stable")
    for b in by_size[count[by_size] > 1].tolist():
        own = order[first[b] : first[b] + count[b]]
        start, stride = place[own][:, None], step[own][:, None]
        seed = trial
        while True:  # 64 seeds at a time, as _slots has them
            slots = (((start + seed * stride) >> np.uint64(16)) % size).astype(np.int64)
            free = np.flatnonzero(~taken[slots].any(axis=0))
            for k in free.tolist():
                found = slots[:, k].tolist()
                if len(set(found)) == len(found):
                    seeds[b] = seed[k]
                    taken[found] = True
                    break
            else:
                seed = seed + np.uint64(64)
                continue
            break
    alone = np.flatnonzero(count == 1)
    seeds[alone] = -np.flatnonzero(~taken)[: len(alone)] - 1
    return seeds


def _bucket_seeds(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return seeds[(_hash(keys, 1) % np.uint64(len(seeds))).astype(np.int64)]


INDEX = "part int, n int, seeds binary, fingerprint binary, shard binary, block binary, position binary"
ENTRY = "doc_id long, shard int, block int, position long"


def _index_part(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["doc_id"].to_numpy(np.int64)
    seeds = perfect_hash(keys)
    slot = _slots(keys, _bucket_seeds(keys, seeds), len(keys))
    order = np.argsort(slot)
    fields = {
        "part": [int(rows["part"].iloc[0])],
        "n": [len(keys)],
        "seeds": [seeds.astype("<i8").tobytes()],
        "fingerprint": [_hash(keys, 4)[order].astype("<u4").tobytes()],
        "shard": [rows["shard"].to_numpy("<i4")[order].tobytes()],
        "block": [rows["block"].to_numpy("<i4")[order].tobytes()],
        "position": [rows["position"].to_numpy("<i8")[order].tobytes()],
    }
    return pd.DataFrame(fields)


def _read_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("position", pa.int64())])
    for rows in given_back(batches):
        for row in rows.to_pylist():
            counts = np.array([d["n"] for d in row["docs"]], np.int64)
            places = row["first"] + np.cumsum(counts) - counts
            ids = pa.array([d["doc_id"] for d in row["docs"]], pa.int64())
            at = [pa.array(np.full(len(counts), row[name], np.int32)) for name in ("shard", "block")]
            yield pa.RecordBatch.from_arrays([ids, *at, pa.array(places)], schema=schema)


def build_index(payload: DataFrame, path: str) -> None:
    """Write the perfect hash index of a payload, PART_KEYS keys to a part."""
    places = payload.select("shard", "block", "first", "docs").mapInArrow(_read_places, ENTRY)
    keys = places.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    entries = keys.agg(F.min(F.struct("shard", "block", "position")).alias("place"))
    entries = entries.select("doc_id", "place.*")
    parts = payload.agg(F.sum(F.size("docs"))).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts // PART_KEYS + 1)).cast("int")
    built = entries.withColumn("part", part).groupBy("part").applyInPandas(_index_part, INDEX)
    built.write.parquet(path)


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    ids = keys["doc_id"].to_numpy(np.int64)
    if index.empty or not len(ids):
        return pd.DataFrame({"doc_id": ids[:0], "shard": ids[:0], "block": ids[:0], "position": ids[:0]})
    row = index.iloc[0]
    seeds = np.frombuffer(row["seeds"], "<i8")
    slot = _slots(ids, _bucket_seeds(ids, seeds), int(row["n"]))
    same = np.frombuffer(row["fingerprint"], "<u4")[slot] == _hash(ids, 4).astype("<u4")
    slot = slot[same]
    return pd.DataFrame(
        {
            "doc_id": ids[same],
            "shard": np.frombuffer(row["shard"], "<i4")[slot],
            "block": np.frombuffer(row["block"], "<i4")[slot],
            "position": np.frombuffer(row["position"], "<i8")[slot],
        }
    )


RECORD = "doc_id long, shard int, position long, n_tokens long, ids_crc32 long"


def _records() -> tuple[list[str], pa.Schema]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return names, pa.schema(list(zip(names, kinds)))


def _read_unkeyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records without an id."""
    names, schema = _records()
    for rows in given_back(batches):
        found = []
        for row in rows.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            at = 0
            for doc in row["docs"]:
                own = ids[at : at + doc["n"]]
                if doc["doc_id"] is None:
                    found.append((None, row["shard"], row["first"] + at, len(own), zlib.crc32(own)))
                at += doc["n"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema)


def _found_in(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, position, ids) of the records that stand where the index says.

    A block comes with `wanted`, (position, doc_id) of keys. A position at which no record
    begins, or one of another id, gives nothing. The records after it that repeat the id
    are read on.
    """
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    docs = row["docs"]
    ends = np.cumsum([d["n"] for d in docs])
    starts = ends - [d["n"] for d in docs]
    at_start = {int(at): k for k, at in enumerate(starts)}
    for want in row["wanted"]:
        k = at_start.get(want["position"] - row["first"], len(docs))
        while k < len(docs) and docs[k]["doc_id"] == want["doc_id"]:
            yield want["doc_id"], row["first"] + int(starts[k]), ids[starts[k] : ends[k]]
            k += 1


def _read_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, schema = _records()
    for rows in given_back(batches):
        for row in rows.to_pylist():
            found = [
                (key, row["shard"], at, len(own), zlib.crc32(own.astype("<u4"))) for key, at, own in _found_in(row)
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema)


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    for rows in given_back(batches):
        for row in rows.to_pylist():
            found = [{"doc_id": key, "ids": own.astype(np.int32).tolist()} for key, _, own in _found_in(row)]
            yield pa.RecordBatch.from_pylist(found, schema)


class TokenStore:
    """The two tables of a token store, for reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
        self.index = spark.read.schema(INDEX).parquet(f"{path}/index")

    def lookup(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """Place (shard, position) of the first record of each key that is in the store.

        Keys meet the part of the index that their hash names; a key that was never put
        in is rejected by its fingerprint (a wrong one passes with chance 2^-32).
        """
        parts = self.index.agg(F.max("part")).first()[0]
        wanted = keys.select(F.col(key).cast("long").alias("doc_id")).where(F.col(key).isNotNull()).distinct()
        if parts is None:
            return wanted.sparkSession.createDataFrame([], ENTRY)
        total = self.payload.agg(F.sum(F.size("docs"))).first()[0]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(total // PART_KEYS + 1)).cast("int")
        groups = wanted.withColumn("part", part).groupBy("part")
        return groups.cogroup(self.index.groupBy("part")).applyInPandas(_find, ENTRY)

    def _wanted(self, places: DataFrame, repeats: bool) -> DataFrame:
        """The blocks that hold the given places, each with its places.

        With `repeats` also the blocks that begin with the id of a place before them: there
        the records that repeat the id go on.
        """
        wanted = places.select("shard", "block", "position", "doc_id")
        if repeats:
            heads = self.payload.select("shard", "block", "first", F.get("docs", F.lit(0))["doc_id"].alias("doc_id"))
            start = places.select("doc_id", F.col("shard").alias("_shard"), F.col("position").alias("_position"))
            later = heads.join(start, "doc_id").where(F.struct("shard", "first") > F.struct("_shard", "_position"))
            wanted = wanted.unionByName(later.select("shard", "block", F.col("first").alias("position"), "doc_id"))
        grouped = wanted.groupBy("shard", "block").agg(F.collect_list(F.struct("position", "doc_id")).alias("wanted"))
        return self.payload.join(grouped, ["shard", "block"])

    def records(self, places: DataFrame) -> DataFrame:
        """All records of the keys at the given places: place, doc_id, number of ids, CRC-32."""
        return self._wanted(places, True).mapInArrow(_read_found, RECORD)

    def unkeyed(self) -> DataFrame:
        """The records without an id, which no key can reach."""
        return self.payload.where(F.exists("docs", lambda d: d["doc_id"].isNull())).mapInArrow(_read_unkeyed, RECORD)

    def documents(self, keys: DataFrame) -> DataFrame:
        """The ids of the given documents, found through the index: only their blocks are used."""
        return self._wanted(self.lookup(keys), True).mapInArrow(_read_ids, "doc_id long, ids array<int>")

    def starts(self) -> DataFrame:
        """Ids of the whole store before each shard."""
        n = F.aggregate("docs.n", F.lit(0).cast("long"), lambda a, n: a + n)
        shards = self.payload.groupBy("shard").agg(F.sum(n).alias("n"))
        order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))


def write_store(docs: DataFrame, path: str, vocabulary: str) -> TokenStore:
    """Write the payload and the index of all documents below `path`."""
    spark = docs.sparkSession
    write_payload(docs, f"{path}/payload", vocabulary)
    build_index(spark.read.schema(PAYLOAD).parquet(f"{path}/payload"), f"{path}/index")
    return TokenStore(spark, path)


def stored_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write `docs` to a new token store and read it back through the index.

    One row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, shard, position. Each key is looked up in the index, its block is fetched and
    its ids are those at its position; where an id repeats, the records after it go on, over
    blocks and shards. Documents without an id, which no key can reach, come first. An
    empty table gives no rows.
    """
    import public_tokenizers

    path = scratch_dir(docs.sparkSession, "tokens")
    store = write_store(docs, path, vocabulary or public_tokenizers.path(VOCABULARY))
    places = written(store.lookup(docs), "places")
    found = store.records(places).unionByName(store.unkeyed())
    return found.join(store.starts(), "shard").select(
        "doc_id",
        (F.col("base") + F.col("position")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
        "position",
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_documents(table(spark, sf_dir, "documents"))
