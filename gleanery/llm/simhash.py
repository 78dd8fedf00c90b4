"""Near-duplicate documents by SimHash, compared in bit-sliced form.

Fingerprints have 64 bits. Equal ones are collapsed first; the distinct ones that differ
in at most two bits are linked. Of four blocks of 16 bits two must be equal in a linked
pair, so each fingerprint goes to six buckets, one per pair of blocks. Inside a bucket
the fingerprints are turned into bit planes: plane p holds bit p of 64 fingerprints in
one machine word. One XOR and a few carry-save additions per plane then update the
distances of all fingerprints of a block at once, and a block is abandoned as soon as
all its distances exceed the radius.

A bucket of more than CROWDED fingerprints is cut again by the other 32 bits: of four
blocks of 8 two must be equal. Such a bucket agrees in 48 bits, so it cannot hold more
than 2^16 fingerprints, however the data look.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from gleanery.llm.common import given_back, packed, table, utf8_buffer
from gleanery.llm.components import components
from gleanery.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2
CROWDED = 4096
# Buckets up to this size are compared pair by pair, many buckets at once.
SMALL = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


@F.arrow_udf(LongType())
def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SimHash of each text as a signed long: lower-cased A-Z, words between ASCII white
    space, shingles of three words with repeats, XXH64 with seed 42. A text of fewer
    words is one shingle; null and empty texts have fingerprint 0."""
    for texts in given_back(batches):
        data, bounds = utf8_buffer(texts)
        data = memoryview(data)
        found = [fingerprint_of(bytes(data[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.array(np.array(found, np.uint64).view(np.int64))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Row p holds bit p of all values, 64 of them in a word; spare lanes are zero."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within_radius(differences: Iterator[np.ndarray], radius: int = RADIUS) -> np.ndarray:
    """Lanes whose planes of differing bits add up to at most `radius`.

    Carry-save counters of two bits, so the radius is at most 2: `ones` and `twos` hold
    the count of each lane, `far` remembers lanes that have reached three. The planes
    that are left are not looked at once all lanes are far.
    """
    ones = twos = far = np.uint64(0)
    for plane in differences:
        carry = ones & plane
        ones = ones ^ plane
        far = far | (twos & carry)
        twos = twos ^ carry
        far = far | (twos & (ones if radius == 2 else _ONES))
        if np.all(far == _ONES):
            break
    return ~far


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def _linked_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) are linked, in bit-sliced blocks."""
    found = []
    for at in range(0, len(a), 1 << 14):
        x = a[at : at + (1 << 14)] ^ b[at : at + (1 << 14)]
        found.append(at + _lanes(within_radius(iter(bit_planes(x))), len(x)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _reached(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Links that span the components of one larger bucket.

    From each fingerprint in turn the ones not reached so far are compared at once; those
    within the radius are reached from it. No pair is looked at twice, and a dense
    group shrinks with every step.
    """
    left = values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        planes = bit_planes(left)
        alive = np.full(planes.shape[1], _ONES)
        if len(left) % 64:
            alive[-1] = np.uint64((1 << (len(left) % 64)) - 1)
        # Planes in which all are equal add nothing.
        while queue and alive.any():
            value = queue.pop()
            words = np.flatnonzero(alive)
            flips = (_ONES if int(value) >> p & 1 else np.uint64(0) for p in range(64))
            near = within_radius(planes[p, words] ^ flip for p, flip in enumerate(flips)) & alive[words]
            if not near.any():
                continue
            alive[words] &= ~near
            hits = np.zeros(planes.shape[1], np.uint64)
            hits[words] = near
            reached = left[_lanes(hits, len(left))]
            yield reached, value
            queue.extend(reached)
        left = left[_lanes(alive, len(left))]


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all buckets of a sorted partition. Rows are (bucket, fp); a bucket may run
    over several batches and is held whole: it has a proven bound."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(u, v):
        u, v = np.asarray(u, np.uint64).view(np.int64), np.asarray(v, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    def links(keys, values):
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        count = np.diff(np.append(first, len(keys)))
        lag_a, lag_b = [], []
        small = np.repeat(np.where(count <= SMALL, count, 0), count)
        place = np.arange(len(keys)) - np.repeat(first, count)
        for lag in range(1, SMALL):
            a = np.flatnonzero(place + lag < small)
            if not len(a):
                break
            lag_a.append(a)
            lag_b.append(a + lag)
        if lag_a:
            a, b = values[np.concatenate(lag_a)], values[np.concatenate(lag_b)]
            near = _linked_pairs(a, b)
            yield emit(a[near], b[near])
        for k in np.flatnonzero(count > SMALL).tolist():
            for reached, value in _reached(values[first[k] : first[k] + count[k]]):
                yield emit(reached, np.full(len(reached), value))

    held_keys, held_values = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for rows in given_back(batches):
        columns = [rows.column(c).to_numpy() for c in ("part", "bucket")]
        keys = np.concatenate((held_keys, np.column_stack(columns)))
        values = np.concatenate((held_values, rows.column("fp").to_numpy().view(np.uint64)))
        whole = np.flatnonzero((keys != keys[-1]).any(axis=1)) if len(keys) else []
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield from links(keys[:cut], values[:cut])
        held_keys, held_values = keys[cut:], values[cut:]
    if len(held_keys):
        yield from links(held_keys, held_values)


def _field(value: Column, block: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, block * bits).bitwiseAND((1 << bits) - 1)


def _pair_keys(value: Column, bits: int) -> Column:
    """One (table, value) per pair of the four blocks of `bits` bits."""
    keys = [
        F.struct(
            F.lit(t).alias("table"),
            F.shiftleft(_field(value, i, bits), bits).bitwiseOR(_field(value, j, bits)).alias("value"),
        )
        for t, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return F.explode(F.array(*keys))


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (`fp`) within the radius.

    Not every linked pair is a row: a bucket gives links that span its components.
    """
    keyed = fingerprints.select("fp", _pair_keys(F.col("fp"), 16).alias("k"))
    keyed = keyed.select("fp", F.col("k.table").cast("long").alias("part"), F.col("k.value").alias("bucket"))
    sizes = keyed.groupBy("part", "bucket").count().where("count > 1")
    sizes = written(sizes, "buckets")
    plain = keyed.join(sizes.where(F.col("count") <= CROWDED), ["part", "bucket"], "left_semi")
    crowded = keyed.join(sizes.where(F.col("count") > CROWDED), ["part", "bucket"], "left_semi")
    # The 32 bits outside the two equal blocks, as one number.
    rest = F.lit(None).cast("long")
    for t, pair in enumerate(combinations(range(4), 2)):
        i, j = (b for b in range(4) if b not in pair)
        other = F.shiftleft(_field(F.col("fp"), i, 16), 16).bitwiseOR(_field(F.col("fp"), j, 16))
        rest = F.when(F.col("part") == t, other).otherwise(rest)
    finer = crowded.withColumn("k", _pair_keys(rest, 8)).select(
        "fp",
        (F.col("part") + 6 * (1 + F.col("k.table"))).alias("part"),
        F.shiftleft("bucket", 16).bitwiseOR(F.col("k.value")).alias("bucket"),
    )
    buckets = plain.select("part", "bucket", "fp").unionByName(finer.select("part", "bucket", "fp"))
    dealt = buckets.repartition("part", "bucket").sortWithinPartitions("part", "bucket", "fp")
    return dealt.mapInArrow(link_buckets, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fp, component_id, root.

    `component_id` is the least doc_id of all documents reachable over links, `root` the
    least fingerprint among them. Null and empty texts have fingerprint 0 and link like
    others. Rows without an id belong to their component, but give it no id; a component of
    such rows alone has the id null. Repeated rows are answered each; an empty table
    gives no rows.
    """
    prints = written(docs.select("doc_id", simhash("text").alias("fp")), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    linked = written(distinct.join(roots, "fp"), "linked")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(ids, "root").select("fp", "root", "component_id")
    classes = distinct.join(found, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return prints.join(classes, "fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least doc_id, with its own columns.

    Of several rows with that id one stays. Of a component without ids one row stays.
    Rows with an id that occurs once need no look at their text again; the others (repeated
    ids, no id) do, and are few unless ids repeat.
    """
    found = written(near_duplicates(docs), "components")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    times = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = stays.select("doc_id").distinct().join(times, "doc_id")
    rows = docs.select(F.col("doc_id").alias("key"), packed(docs).alias("doc"))
    once = rows.join(kept.where("times = 1").select(F.col("doc_id").alias("key")), "key", "left_semi")
    repeated = rows.join(kept.where("times > 1").select(F.col("doc_id").alias("key")), "key", "left_semi")
    unnamed = rows.where("key is null")
    other = repeated.unionByName(unnamed).select("key", "doc", simhash("doc.text").alias("fp"))
    classes = found.select("fp", "root", "component_id").distinct()
    other = other.join(classes, "fp").where(F.col("key").eqNullSafe(F.col("component_id")))
    other = other.groupBy("root").agg(F.first("doc").alias("doc"))
    return once.select("doc").unionByName(other.select("doc")).select("doc.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
