import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm.cube import flight, landing, mix, mix_documents, size_of, targets


def shares(sizes):
    """Target of each source by the rule itself, source by source."""
    weights = [1 + k % 3 for k in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        weighed = sum(weights[k] for k in open_)
        above = {k for k in open_ if weights[k] * left / weighed > 3 * sizes[k]}
        if not above:
            for k in open_:
                target[k] = weights[k] * left / weighed
            break
        for k in above:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1000, 1, 1, 1, 900], [0, 10], [7], [1, 2, 3, 4, 50, 600, 7000]])
def test_targets_follow_the_rule(spark, sizes):
    names = [chr(97 + k) for k in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(zip(names, sizes))], "key long, source string, size long")
    got = {r["source"]: r["target"] for r in targets(rows).collect()}
    assert [got[n] for n in names] == pytest.approx(shares(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 500, 3000)
    p = rng.random(3000)
    done = flight(sizes, p, rng)
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert (done * sizes).sum() == pytest.approx((p * sizes).sum())
    assert done.sum() == pytest.approx(p.sum())
    settled = landing(sizes, p[:3000], rng)
    assert set(np.unique(settled)) <= {0.0, 1.0}
    assert abs((settled * sizes).sum() - (p * sizes).sum()) < 10


def test_mix_comes_near_targets_in_any_cut(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", int(rng.integers(0, 400))) for k in range(3000)]
    sized = spark.createDataFrame(rows, "key long, source string, size long")
    for shard_rows in (20_000, 50):
        got = mix(sized, shard_rows).withColumn("taken", F.col("size") * F.col("copies"))
        per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"))
        for r in per.collect():
            assert r["taken"] == pytest.approx(r["target"], rel=0.03, abs=200)
        assert got.count() == 3000 and got.where("copies > 3 or copies < 0").count() == 0
        again = mix(sized.repartition(5), shard_rows).groupBy().agg(F.sum(F.col("key") * F.col("copies"))).first()
        assert again == got.groupBy().agg(F.sum(F.col("key") * F.col("copies"))).first()


def test_documents_are_repeated_with_their_columns(spark, odd_docs, no_docs):
    mixed = mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    sized = odd_docs.select(F.xxhash64("doc_id").alias("key"), "source", size_of(F.col("text")).alias("size"))
    assert mixed.where("text is not null and length(trim(text)) > 0").count() > 0
    known = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= known
    assert mix(sized).count() == odd_docs.count()
    assert mix_documents(no_docs).count() == 0 and mix(sized.limit(0)).count() == 0


def test_large_keys_beside_null(spark):
    """A null id in a shard leaves the 64-bit ids beside it as they are."""
    rows = spark.range(0, 400, 1, 3).select(
        F.when(F.col("id") % 20 != 0, F.col("id") + 2**60).alias("key"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("size")
    )
    got = mix(rows, shard_rows=40).collect()
    assert sorted((r["key"] or 0) for r in got) == sorted((r["key"] or 0) for r in rows.collect())
