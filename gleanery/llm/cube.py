"""Mixing sources to target weights by the cube method.

A source with target t and size s wants every document t / s times: the whole part as
plain copies, the fraction as an inclusion probability. The cube method turns the
fractions into zeros and ones while two totals of each source stay as they are: words
and documents. Its flight phase takes three undecided documents at a time and moves
their probabilities along the direction that changes neither total (the null space of
the 2 x 3 constraint matrix) until one of them is zero or one; this ends with at most
two undecided documents.

Here a source is cut into shards of about SHARD_ROWS documents, so a large source is
spread over many tasks. Each shard flies by itself; the at most two documents left of
each shard fly again in the next round, until a source is one shard. Only then does the
landing phase decide the rest: the last two and a reserve of documents, which make up for
what the decision on the two adds or takes away. All choices come from a generator seeded by shard and round:
reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.common import packed, row_identity, table
from gleanery.operators.lookup import lookup_join
from gleanery.session import written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SHARD_ROWS = 2000
# Documents of the last shard that are left out of its flight, for the landing.
RESERVE = 300
SEED = 6
_TINY = 1e-9


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number sources from 0 in code point order, nulls last, without one task for all:
    a sort by ranges, then the rows of the ranges before."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    placed = ordered.select("*", F.monotonically_increasing_id().alias("id"))
    placed = written(placed, "ranks").select(
        "*", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at")
    )
    counts = placed.groupBy("range").count().collect()  # one number per range
    before, total = {}, 0
    for row in sorted(counts):
        before[row["range"]] = total
        total += row["count"]
    if not before:
        return placed.select("source", "size", "n", F.col("at").alias("rank"))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return placed.select("source", "size", "n", (F.col("at") + offset[F.col("range")]).alias("rank"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target of each source: source, source_size, n, rank, target.

    Sources in code point order, null last, weigh `weights` in turn and share the total
    size. A target stops at `most` times the size of its source; the excess is shared
    again by weight among the others until none is above. The share per unit of weight
    only grows while this goes on, so the driver needs one number and one small
    aggregate per round.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "sources")
    cap = F.col("size") * most
    total, weighed = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / weighed if weighed else 0.0
    while True:
        above = F.when(cap < F.col("weight") * F.lit(share), True)
        capped, out = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0)),
        ).first()
        after = (total - capped) / (weighed - out) if weighed > out else share
        if after <= share:
            break
        share = after
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(share)))
    return ranked.select("source", F.col("size").alias("source_size"), "n", "rank", target.alias("target"))


def _direction(sizes: list[float]) -> tuple[float, float, float]:
    """A direction that keeps sum(size * p) and sum(p), for three documents."""
    a, b, c = sizes
    u = (b - c, c - a, a - b)
    return u if any(u) else (1.0, -1.0, 0.0)


def _step(p, u, draw):
    """Move p along u or against it until one value is zero or one, by chance so that
    every expectation stays. Values within rounding of the ends are put there."""
    ahead = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, u) if d)
    back = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, u) if d)
    by = ahead if draw * (ahead + back) < back else -back
    moved = [x + by * d for x, d in zip(p, u)]
    return [0.0 if x < _TINY else 1.0 if x > 1 - _TINY else x for x in moved]


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase over one shard: at most two values are left between zero and one."""
    done = p.copy()
    active: list[int] = []
    draws = iter(rng.random(len(p)).tolist())
    at_sizes, at_p = sizes.astype(float).tolist(), p.tolist()
    for k, x in enumerate(at_p):
        if not 0 < x < 1:
            continue
        active.append(k)
        while len(active) == 3:
            own = [at_sizes[i] for i in active]
            moved = _step([at_p[i] for i in active], _direction(own), next(draws, None) or rng.random())
            for i, value in zip(active, moved):
                at_p[i] = done[i] = value
            active = [i for i in active if 0 < at_p[i] < 1]
    return done


def landing(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide all that is left, the number of documents given up and the words kept.

    From the largest document down, one is moved against all smaller ones at once, each
    in proportion to its size and its room, so that the words stay as they are. So
    large documents are settled while small ones can still make up for them. Where the
    others could make up for only one of the two ways, that way is taken; where for
    none, the last document is rounded.
    """
    done = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    left = left[np.argsort(-sizes[left], kind="stable")]
    while len(left) > 1:
        own, x = sizes[left].astype(float), done[left]
        u = -own * x * (1 - x)
        u[0] = 1.0
        spread = -(own[1:] * u[1:]).sum()
        u[1:] *= own[0] / spread if spread else 0.0
        u[np.abs(u) < 1e-15] = 0.0
        takes = own[0] * (1 - x[0]) <= (own[1:] * x[1:]).sum()
        leaves = own[0] * x[0] <= (own[1:] * (1 - x[1:])).sum()
        draw = rng.random() if takes == leaves else float(leaves)
        done[left] = _step(x.tolist(), u.tolist(), draw)
        left = left[(done[left] > 0) & (done[left] < 1)]
    done[left] = np.round(done[left])
    return done


FLOWN = "key long, size long, rank long, shard long, shards long, copies int, p double"


def _fly(round_number: int, shard_rows: int):
    def fly(rows: pa.Table) -> pa.Table:
        # Keys stay in Arrow, where a null beside them leaves their 64 bits as they are.
        rows = rows.sort_by([("size", "descending"), ("key", "ascending")])
        rank, shard, shards = (rows.column(c)[0].as_py() for c in ("rank", "shard", "shards"))
        rng = np.random.default_rng([SEED, round_number, rank, shard])
        sizes, p = rows.column("size").to_numpy(), rows.column("p").to_numpy().copy()
        # The last shard keeps some documents of all sizes for the landing.
        aside = min(RESERVE, len(p) // 2) if shards == 1 else 0
        flying = np.sort(rng.permutation(len(p))[aside:])
        p[flying] = flight(sizes[flying], p[flying], rng)
        if shards == 1:
            p = landing(sizes, p, rng)
        ended = p >= 1
        left = -(-shards * 2 // shard_rows)
        changed = {
            "copies": pa.array(rows.column("copies").to_numpy() + ended.astype(np.int32)),
            "p": pa.array(np.where(ended, 0.0, p)),
            "shards": pa.array(np.full(len(p), left, np.int64)),
            "shard": pa.array(np.full(len(p), shard % left, np.int64)),
        }
        names = [f.split()[0] for f in FLOWN.split(", ")]
        return pa.table({n: changed.get(n, rows.column(n)) for n in names})

    return fly


def mix(sized: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Decide how often each document is taken.

    `sized` has key (a long that names the row, repeats allowed), source and size. Gives
    one row per row: key, size, source, source_size, target, copies (0 to 3). Documents of
    size 0 take part in the number of documents. A source whose size is 0 has no copies.
    An empty table gives no rows.
    """
    shared = targets(sized)
    name = F.struct("source").alias("name")  # a struct is equal to itself where its field is null
    rows = lookup_join(sized.select("key", "size", name), shared.withColumn("name", name).drop("source"), "name")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(wish + _TINY).cast("int")
    shards = F.ceil(F.col("n") / F.lit(shard_rows)).cast("long")
    now = rows.select(
        "key",
        "size",
        "rank",
        F.pmod(F.xxhash64("key", "size"), shards).alias("shard"),
        shards.alias("shards"),
        copies.alias("copies"),
        F.greatest(wish - copies, F.lit(0.0)).alias("p"),
    )
    decided, number = None, 0
    while True:
        flown = now.groupBy("rank", "shard").applyInArrow(_fly(number, shard_rows), FLOWN)
        flown = written(flown, "flown")
        final = flown.where("p = 0")
        decided = final if decided is None else decided.unionByName(final)
        now, number = flown.where("p > 0"), number + 1
        if now.isEmpty():
            break
    return lookup_join(decided.select("key", "size", "rank", "copies"), shared, "rank")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns.

    Repeated rows are interchangeable: their copies are added up and made from one of
    them, after combining them before any shuffle.
    """
    keyed = docs.select(row_identity(docs).alias("key"), packed(docs).alias("doc"))
    sized = written(keyed.select("key", F.col("doc.source").alias("source"), size_of(F.col("doc.text")).alias("size")), "sizes")
    taken = written(mix(sized).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "taken")
    taken = taken.where("copies > 0")
    once = keyed.join(taken.where("rows = 1"), "key").select("doc", "copies")
    repeated = keyed.join(taken.where("rows > 1"), "key").groupBy("key", "copies").agg(F.first("doc").alias("doc"))
    mixed = once.unionByName(repeated.select("doc", "copies"))
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; `taken` is the words of all copies that the mix takes of one."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").alias("key"), "source", size_of(F.col("text")).alias("size"))
    return mix(written(sized, "sizes")).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "source",
        "copies",
    )
