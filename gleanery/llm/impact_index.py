"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are integers. A shard of the index holds the postings of its vectors (one per
component) in segments of falling quantised impact: the largest components first. A
search adds the segments to the scores of all vectors of the shard, largest first. What
is not added yet can change a score by no more than |query| * |rest of the vector|
(Cauchy-Schwarz; the norms of the rests are stored per segment). Once few vectors can
still reach the k-th best certain score, this is the proof that no other belongs to the
answer: the search stops and rescores the possible members exactly.

Every query of the stated set meets every shard, in blocks of queries. A pair of block and
shard gives k rows per query, and the best of all shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import table
from gleanery.session import written

SCALE = 256
TOP = 5
QUERY_EVERY = 50
SHARD_ROWS = 8192
BLOCK_QUERIES = 256
# Shares of the postings, by falling impact, after which a segment ends.
SEGMENTS = (0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)
# A search stops when at most this share of a shard is possible.
FEW = 0.05

SHARD = "shard int, n int, width int, ids binary, vectors binary, starts binary, rows binary, values binary, rests binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(rows: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max((len(v) for v in rows), default=0)
    matrix = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows):
        matrix[k, : len(v)] = v
    return matrix


def index_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: the postings (vector, value) of each segment, component by component, and for
    each segment the norm of what is left of each vector after it.

    `starts` has the first posting of each component of each segment, in order, and the end.
    """
    rows = rows.sort_values("vec_id", kind="stable")
    vectors = _matrix(rows["vector"])
    size = np.abs(vectors)
    bounds = np.quantile(size, [1 - s for s in SEGMENTS[:-1]]) if size.size else np.zeros(len(SEGMENTS) - 1)
    levels = sum(((size < b).astype(np.int8) for b in bounds), np.zeros(size.shape, np.int8))
    squares = size.astype(float) ** 2
    rests = [np.sqrt((squares * (levels > g)).sum(axis=1)) for g in range(len(SEGMENTS))]
    postings = [np.nonzero(((levels == g) & (vectors != 0)).T) for g in range(len(SEGMENTS))]
    component, row = (np.concatenate(parts) for parts in zip(*postings))
    counts = [np.bincount(d, minlength=vectors.shape[1]) for d, _ in postings]
    return pd.DataFrame(
        {
            "shard": [int(rows["shard"].iloc[0])],
            "n": [len(rows)],
            "width": [vectors.shape[1]],
            "ids": [rows["vec_id"].to_numpy("<i8").tobytes()],
            "vectors": [vectors.astype("<i8").tobytes()],
            "starts": [np.cumsum([0, *np.concatenate(counts)]).astype("<i4").tobytes()],
            "rows": [row.astype("<i4").tobytes()],
            "values": [vectors[row, component].astype("<f8").tobytes()],
            "rests": [np.array(rests, "<f8").tobytes()],
        }
    )


class Shard:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.width = row["width"]
        self.vectors = np.frombuffer(row["vectors"], "<i8").reshape(row["n"], self.width)
        self.starts = np.frombuffer(row["starts"], "<i4").tolist()
        self.rows, self.values = np.frombuffer(row["rows"], "<i4"), np.frombuffer(row["values"], "<f8")
        self.rests = np.frombuffer(row["rests"], "<f8").reshape(len(SEGMENTS), row["n"])
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))

    def add_segment(self, g: int, queries: np.ndarray, scores: np.ndarray) -> None:
        """Add a segment to the scores (a row per vector, a column per query): each posting
        is met once. A component has a vector at most once, so no two postings collide."""
        for d in range(queries.shape[1]):
            at, end = self.starts[g * self.width + d : g * self.width + d + 2]
            if at < end:
                scores[self.rows[at:end]] += self.values[at:end, None] * queries[:, d]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, vector, score) of the k best of this shard, for each query."""
        width = min(queries.shape[1], self.width)
        queries = queries[:, :width]
        asked = queries.astype(float)
        norms = np.sqrt((asked**2).sum(axis=1))
        # Room for rounding of the float sums, far below one unit for usual vectors.
        slack = 1e-9 * self.norms[:, None] * norms[None, :] + 1e-6
        scores = np.zeros((len(self.ids), len(queries)))
        own = self.ids[:, None] == query_ids[None, :]
        todo = np.arange(len(queries))
        rows, columns = [], []
        few = max(4 * k, int(FEW * len(self.ids)))
        best = len(self.ids) - k
        for g in range(len(SEGMENTS)):
            self.add_segment(g, asked[todo], scores)
            last = g == len(SEGMENTS) - 1
            if not last and SEGMENTS[g] < 0.6:
                continue
            bound = self.rests[g][:, None] * norms[None, todo] + slack[:, todo]
            sure = np.where(own[:, todo], -np.inf, scores - bound)
            least = np.partition(sure, best, axis=0)[best] if best > 0 else np.full(len(todo), -np.inf)
            possible = (scores + bound >= least[None, :]) & ~own[:, todo]
            proven = np.full(len(todo), True) if last else possible.sum(axis=0) <= few
            v, q = np.nonzero(possible & proven[None, :])
            rows.append(todo[q])
            columns.append(v)
            # Queries that are answered leave; the others go on to the next segment.
            todo, scores = todo[~proven], np.ascontiguousarray(scores[:, ~proven])
            if not len(todo):
                break
        q, v = np.concatenate(rows), np.concatenate(columns)
        score = np.zeros(len(q), np.int64)
        for at in range(0, len(q), 1 << 15):
            part = slice(at, at + (1 << 15))
            score[part] = (queries[q[part]] * self.vectors[v[part], :width]).sum(axis=1)
        order = np.lexsort((self.ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        return query_ids[q[top]], self.ids[v[top]], score[top]


def _searcher(k: int):
    """A stream of shards, each before the blocks of queries that meet it; a shard without
    vectors is not in it."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for rows in batches:
            for at in range(rows.num_rows):
                row = {name: rows.column(name)[at].as_py() for name in rows.schema.names}
                if row["query_ids"] is None:
                    shard, number = Shard(row), row["shard"]
                if row["query_ids"] is None or row["shard"] != number:
                    continue
                ids = np.frombuffer(row["query_ids"], "<i8")
                queries = np.frombuffer(row["queries"], "<i8").reshape(len(ids), -1)
                found = shard.search(ids, queries, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    return search


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    return pd.DataFrame(
        {
            "block": [int(rows["block"].iloc[0])],
            "query_ids": [rows["vec_id"].to_numpy("<i8").tobytes()],
            "queries": [_matrix(rows["vector"]).astype("<i8").tobytes()],
        }
    )


def _dealt(rows: DataFrame, name: str, count: int, size: int) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count // size + 1)).cast("int"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best of `vectors` for each of `queries` by integer inner product.

    Both have vec_id and vector (array<long>). Gives query_id, rank (from 1), vec_id, score;
    equal scores go to the smaller vec_id. Rows with a query's own id are not its
    candidates. Null ids and null vectors take no part. A shorter vector counts as
    filled up with zeros. Of several queries with one id the least vector is asked. Fewer
    candidates than k give fewer rows, none give none.
    """
    whole = "vec_id is not null and vector is not null"
    vectors = written(vectors.where(whole), "vectors")
    asked = queries.where(whole).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(asked, "queries")
    count, questions = vectors.count(), asked.count()
    index = _dealt(vectors, "shard", count, SHARD_ROWS).groupBy("shard").applyInPandas(index_shard, SHARD)
    index = written(index, "impact-index")
    blocks = _dealt(asked, "block", questions, BLOCK_QUERIES).groupBy("block").applyInPandas(
        _block, "block int, query_ids binary, queries binary"
    )
    # Every block meets every shard: the blocks are repeated, a shard is sent once, before them.
    every = F.explode(F.sequence(F.lit(0), F.lit(count // SHARD_ROWS))).alias("shard")
    asking = blocks.select("query_ids", "queries", every)
    met = index.unionByName(asking, allowMissingColumns=True).repartition("shard")
    met = met.sortWithinPartitions("shard", F.col("query_ids").isNotNull())
    found = met.mapInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


OP8_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vector
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: z[1] * z[2])) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
    vec_id, score
from s
qualify rank <= 5
"""
