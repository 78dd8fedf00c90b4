"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import fold
from gleanery.session import written

# Most rows a classifier learns from: those whose ids have the least digests.
SAMPLE_ROWS = 16_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled documents outside the held-out fold: fold (1 to 4), label (0 or 1), text.

    At most `rows` labelled ids are taken, by the least digest of the id, so a rerun takes
    the same. Labels that are null are left out; an id with several labels has that of
    the majority (1 where they tie). Ids that repeat in `docs` bring each row.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = known.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(written(chosen, "chosen")), "doc_id")
    return found.select(fold(F.col("doc_id")).cast("int").alias("fold"), "label", "text")
