"""Connected components of a graph whose nodes are numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.session import remove_folder, scratch_dir


def _stored(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    spark = edges.sparkSession
    path = scratch_dir(spark, "edges")
    edges.write.parquet(path)
    kept = spark.read.schema(edges.schema).parquet(path)
    state = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return kept, path, tuple(state)


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them."""
    if both_ways:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        links = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        links = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = links.unionByName(least.select("u", F.col("m").alias("v")))
    return links.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least node (`root`) that each node (`node`) with an edge can reach.

    `edges` has two long columns, u and v, in any direction. Large-star and
    small-star rounds alternate until the edges are stars around their roots, which takes
    about log^2 of the diameter rounds at most. Each round is an aggregate of minima,
    which combines before the shuffle, and a plain join, which adaptive execution can
    split at a hub. Every round is written to the shared folder and read back, so a lost
    executor costs one round. The driver sees two numbers per round. No edges, no rows.
    """
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path, state = _stored(directed.where("u > v").distinct())
    while True:
        after, new_path, new_state = _stored(_stars(_stars(now, True), False))
        remove_folder(edges.sparkSession, path)
        now, path = after, new_path
        if new_state == state:
            break
        state = new_state
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
