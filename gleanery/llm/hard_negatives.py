"""Hard negatives by Kronecker-packed products.

Vectors have integer components. Biased so that none is negative, the components of
several candidates become the fields of one integer, each field wide enough for a whole inner
product. One multiplication by a component of an anchor then serves all candidates of the
integer, and the sum over the components holds every candidate's product in its own field:

    sum_d (a_d + A) (x_d + X)  =  a.x  +  A sum(x)  +  X sum(a)  +  D A X

The known rest is taken off, and the score is exact. The integers are as wide as a double
counts exactly (53 bits), so that the products of a block of anchors and a shard are one
matrix product; how many fields fit follows from the largest components. Components so
large that not even one field fits go through Python's integers, which have no width.

Rows are dealt into shards by ranges of (label, id), so a label lies in few shards and a
large label in many. A first pass brings each anchor to the shards of its own label and
finds its positives; a second brings every anchor with its bands to all shards and finds
the best of other labels inside each band. A task reads a shard, then the anchors that
meet it as a stream, so it holds one shard and one block of anchors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import table
from gleanery.llm.impact_index import quantised
from gleanery.session import written

POSITIVES = 5
NEGATIVES = 3
ANCHOR_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
# A negative scores 50 to 95 hundredths of the positive.
BAND = (50, 95)
SHARD_ROWS = 8192
BLOCK_ANCHORS = 256
EXACT_BITS = 53


# --- packed products --------------------------------------------------------------


def field_bits(anchors: np.ndarray, candidates: np.ndarray) -> int:
    """Width of a field that holds any inner product of biased vectors."""
    a = int(anchors.max(initial=0)) - int(anchors.min(initial=0))
    x = int(candidates.max(initial=0)) - int(candidates.min(initial=0))
    return max(1, (candidates.shape[1] * a * x).bit_length())


def pack_fields(biased: np.ndarray, fields: int, bits: int) -> np.ndarray:
    """Rows of several candidates as one row of wide integers, the first in the low field."""
    missing = -len(biased) % fields
    rows = np.concatenate([biased, np.zeros((missing, biased.shape[1]), biased.dtype)])
    grouped = rows.reshape(-1, fields, biased.shape[1])
    wide = grouped[:, 0].astype(object) if rows.dtype == object else grouped[:, 0].copy()
    for k in range(1, fields):
        wide = wide + grouped[:, k] * (1 << (bits * k))
    return wide


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors (rows) with all candidates (columns).

    Integers of any size; a result that int64 cannot hold is an OverflowError.
    """
    if not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    bits = field_bits(anchors, candidates)
    fields = EXACT_BITS // bits
    low_a, low_x = int(anchors.min()), int(candidates.min())
    a, x = anchors - low_a, candidates - low_x
    if not fields:
        a, x = a.astype(object), x.astype(object)
        fields = 4
        sums = a @ pack_fields(x, fields, bits).T
    else:
        sums = (a.astype(float) @ pack_fields(x, fields, bits).astype(float).T).astype(np.int64)
    unpacked = [(sums >> (bits * k)) & ((1 << bits) - 1) for k in range(fields)]
    scores = np.stack(unpacked, axis=2).reshape(len(a), -1)[:, : len(x)]
    # a and x are above zero now: a.x = (a + low_a).(x + low_x) without the three known parts.
    rest_a, rest_x = a.sum(axis=1), x.sum(axis=1)
    scores = scores + low_x * rest_a[:, None] + low_a * rest_x[None, :] + a.shape[1] * low_a * low_x
    if scores.dtype == object:
        if scores.size and max(abs(int(s)) for s in scores.flat) >= 1 << 63:
            raise OverflowError("an inner product is beyond 64 bits")
        scores = scores.astype(np.int64)
    return scores


# --- search in a shard ------------------------------------------------------------


def nearest_alike(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    """(anchor, candidate, score) of the k best of the anchor's own label."""
    at = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return [(anchor["vec_id"], int(ids[i]), int(scores[i])) for i in at.tolist()]


def best_in_band(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    """(anchor, nth positive, candidate, score): the k best of other labels in each band.

    The candidates are sorted by id, so a stable sort keeps the order of ties.
    """
    other = np.flatnonzero(labels != anchor["label"])
    order = other[np.argsort(-scores[other], kind="stable")]
    falling = -scores[order]
    found = []
    for band in anchor["bands"]:
        first = int(np.searchsorted(falling, -band["most"], "left"))
        for i in order[first : first + k].tolist():
            if scores[i] >= band["least"]:
                found.append((anchor["vec_id"], band["nth"], int(ids[i]), int(scores[i])))
    return found


class _Shard:
    """The candidates of a shard, sorted by id; shorter vectors are filled up with zeros."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("vec_id")
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vectors = _matrix(rows.column("vector"))

    def scores(self, anchors: pa.Table) -> np.ndarray:
        asked = _matrix(anchors.column("vector"))
        width = min(asked.shape[1], self.vectors.shape[1])
        return products(asked[:, :width], self.vectors[:, :width])


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.combine_chunks()
    length = np.diff(rows.offsets.to_numpy())
    matrix = np.zeros((len(rows), int(length.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1])[None, :] < length[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return matrix


ALIKE = "anchor_id long, vec_id long, score long"
IN_BAND = "anchor_id long, nth int, vec_id long, score long"


def _searcher(search, schema: str, k: int):
    kinds = {"long": pa.int64(), "int": pa.int32()}
    kind = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])

    def found_in(shard: _Shard, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, anchors.num_rows, BLOCK_ANCHORS):
            block = anchors.slice(at, BLOCK_ANCHORS)
            listed = block.select(["vec_id", "label", "bands"]).to_pylist()
            found: list[tuple] = []
            for anchor, scores in zip(listed, shard.scores(block)):
                found += search(anchor, shard.ids, shard.labels, scores, k)
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kind.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, shard = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            number, asks = rows.column("shard").to_numpy(), rows.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                if first == last:
                    continue
                part = rows.slice(first, last - first)
                if number[first] != held:
                    held, parts, shard = number[first], [], None
                if not asks[first]:
                    parts.append(part)
                elif parts or shard:
                    if shard is None:
                        shard, parts = _Shard(pa.concat_tables(parts)), []
                    yield from found_in(shard, part)

    return run


def _met(asking: DataFrame, shards: DataFrame, search, schema: str, k: int) -> DataFrame:
    """What each anchor finds in the shard it is brought to: a shard's rows come before the
    anchors that ask them."""
    none = F.lit(None).cast("array<struct<nth:int,least:long,most:long>>")
    columns = ["shard", "asks", "vec_id", "label", "vector", "bands"]
    held = shards.withColumn("asks", F.lit(False)).withColumn("bands", none)
    asked = asking.withColumn("asks", F.lit(True))
    asked = asked if "bands" in asking.columns else asked.withColumn("bands", none)
    met = held.select(columns).unionByName(asked.select(columns)).repartition("shard")
    return met.sortWithinPartitions("shard", "asks").mapInArrow(_searcher(search, schema, k), schema)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    Both inputs have vec_id, label and vector (array<long>). A row's score is its integer
    inner product with the anchor, higher first, then the smaller vec_id. An anchor's
    positives are its best rows of the same label, its own id left out; a positive's
    negatives are the best rows of other labels in BAND of its score. Gives anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null take no part. Repeated rows count each; they are combined before any
    shuffle, as no answer holds more than `positives` or `negatives` of them. Of several
    anchors with one id the least (label, vector) asks. A shorter vector counts as filled up
    with zeros. Anchors without positives, positives without negatives and empty tables
    give no rows.
    """
    whole = "vec_id is not null and label is not null and vector is not null"
    plain = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector"]
    once = vectors.where(whole).select(*plain).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(positives, negatives))).cast("int")))
    rows = written(once.select("vec_id", "label", "vector", copies.alias("copy")), "vectors")
    asked = anchors.where(whole).select(*plain).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least"))
    asked = written(asked.select("vec_id", "least.*"), "anchors")
    ranges = rows.count() // SHARD_ROWS + 1
    dealt = rows.repartitionByRange(ranges, "label", "vec_id", "vector", "copy")
    dealt = written(dealt.withColumn("shard", F.spark_partition_id()).drop("copy"), "shards")

    holds = dealt.select("label", "shard").distinct()
    alike = _met(asked.join(holds, "label"), dealt, nearest_alike, ALIKE, positives)
    chosen = _best(alike, ["anchor_id"], positives).withColumnRenamed("rank", "nth")
    chosen = written(chosen, "positives")

    part = [F.col("score").cast("decimal(20,0)") * share / 100 for share in BAND]
    band = F.struct("nth", F.ceil(part[0]).cast("long").alias("least"), F.floor(part[1]).cast("long").alias("most"))
    bands = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(band)).alias("bands"))
    last = dealt.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    every = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard")
    asking = asked.join(bands, "vec_id").select("*", every)
    found = _met(asking, dealt, best_in_band, IN_BAND, negatives)
    named = chosen.select("anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return _best(found, ["anchor_id", "nth"], negatives).join(named, ["anchor_id", "nth"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(vec_id, moved.alias("label"), quantised(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, rows.where(vec_id % ANCHOR_EVERY == 0))


OP13_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vector
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike,
        cast(list_sum(list_transform(list_zip(a.vector, c.vector), lambda z: z[1] * z[2])) as bigint) as score
    from v a join v c on a.vec_id % 50 = 0),
p as (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth
    from s where alike and vec_id <> anchor_id
    qualify nth <= 5)
select p.anchor_id, p.vec_id as positive_id,
    cast(row_number() over (partition by p.anchor_id, p.nth order by s.score desc, s.vec_id) as integer) as rank,
    s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.alike
    and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify rank <= 3
"""
