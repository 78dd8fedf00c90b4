"""Quality scores by the Bradley-Terry model.

A document of label 1 is preferred to one of label 0. The model gives every document
the score w . x of its features and says that i is preferred to j with probability
sigmoid(w . (x_i - x_j)). So w is a logistic regression without intercept on feature
differences of preference pairs. The scores are then cut at a quantile: of all quantiles
of the training scores, the one that tells the labels apart best.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleanery.llm.common import fold, packed, table
from gleanery.llm.labelled import training_sample
from gleanery.session import written

# Documents of the other label that each document is compared with.
OPPONENTS = 4
# The score of a document at the cut.
CUT_SCORE = 0.3
QUANTILES = 200

FEATURES = [
    "log_words", "word_length", "distinct_words", "same_as_before", "top_word", "capitals", "digits",
    "marks", "bars", "shouts", "mark_runs", "marked_words", "sentence_ends", "line_words", "repeated_lines",
    "long_words", "few_words",
]
_MARK_RUN = re.compile(r"[^\w\s,.]{2,}")


def features_of(text: str) -> list[float]:
    """Shares and means that describe how a whole text is made; zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    lines = [line for line in text.split("\n") if line.strip()]
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    letters = "".join(words)
    # Letters, digits and the marks that are written on letters, in any script, are not counted.
    marks = sum(text.count(c) for c in set(text) if not (c.isalnum() or c.isspace() or unicodedata.category(c)[0] == "M"))
    same = sum(a == b for a, b in zip(words, words[1:]))
    # Distinct words fall with length in any text; the root makes texts comparable.
    distinct = len(counts) / n
    upper = sum(map(letters.count, filter(str.isupper, set(letters))))
    return [
        math.log1p(n),
        len(letters) / n,
        distinct * min(1.0, math.sqrt(n) / 20),
        same / n,
        max(counts.values()) / n,
        upper / len(letters),
        sum(map(letters.count, "0123456789")) / len(letters),
        marks / chars,
        text.count("|") / n,
        text.count("!") / n,
        len(_MARK_RUN.findall(text)) / n,
        sum(not w[-1].isalnum() and w[-1] not in ",." for w in words) / n,
        text.count(".") / n,
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(len(w) > 14 for w in words) / n,
        1.0 if n < 8 else 0.0,
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def quality_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([features_of(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))


@dataclass
class Preference:
    """Weights of the features as they are, and the score at the cut."""

    weights: list[float]
    cut: float

    def score(self, features: Column) -> Column:
        """0 to 1, CUT_SCORE at the cut; the features' weighted sum in between."""
        products = F.zip_with(features, F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        shift = math.log(CUT_SCORE / (1 - CUT_SCORE)) - self.cut
        return 1 / (1 + F.exp(-F.greatest(F.least(total + shift, F.lit(500.0)), F.lit(-500.0))))


def preference_pairs(sample: DataFrame, opponents: int = OPPONENTS) -> DataFrame:
    """Feature differences (preferred minus other) of documents of unlike labels.

    Document number i of the larger class meets `opponents` of the smaller class in turn,
    so that every document is in as many pairs as any other of its class. The sample is
    bounded, so its numbering may be one task.
    """
    order = Window.partitionBy("label").orderBy("key", "x")
    numbered = sample.withColumn("i", F.row_number().over(order) - 1)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    many = 1 if n1 >= n0 else 0
    few = max(min(n0, n1), 1)
    turn = F.explode(F.sequence(F.lit(0), F.lit(opponents - 1)))
    left = numbered.where(F.col("label") == many).select("i", "x", turn.alias("t"))
    left = left.select(F.col("x").alias("a"), ((F.col("i") * opponents + F.col("t")) % few).alias("i"))
    right = numbered.where(F.col("label") == 1 - many).select("i", F.col("x").alias("b"))
    sign = 1.0 if many == 1 else -1.0
    return left.join(right, "i").select(F.zip_with("a", "b", lambda a, b: (a - b) * sign).alias("d"))


def fit(sample: DataFrame) -> Preference:
    """Learn from rows of label and text. Without documents of both labels all weights
    are zero and all scores are at the cut."""
    rows = written(
        sample.select("label", quality_features("text").alias("x"), F.xxhash64("text").alias("key")), "quality"
    )
    pairs = written(preference_pairs(rows), "pairs")
    if pairs.isEmpty():
        return Preference([0.0] * len(FEATURES), 0.0)
    won = pairs.select(F.lit(1.0).alias("label"), array_to_vector("d").alias("features"))
    lost = pairs.select(
        F.lit(0.0).alias("label"), array_to_vector(F.transform("d", lambda x: -x)).alias("features")
    )
    learner = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=100)
    weights = learner.fit(won.unionByName(lost)).coefficients.toArray()
    known = rows.select("label", "x").toPandas()  # the bounded sample
    scores = np.array(known["x"].tolist()) @ weights
    label = known["label"].to_numpy()
    cuts = np.unique(np.quantile(scores, np.linspace(0, 1, QUANTILES + 1)))
    between = np.concatenate((cuts[:1], (cuts[1:] + cuts[:-1]) / 2))
    right = [((scores >= c) == (label == 1)).mean() for c in between]
    return Preference(weights.tolist(), float(between[int(np.argmax(right))]))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: its columns as the struct `doc`, score and predicted.

    Null and empty texts have zero features and the score of these. Nothing but the text
    is an input. Repeated rows are scored each.
    """
    model = fit(training_sample(docs, labels, "quality"))
    rows = docs.select(packed(docs).alias("doc"))
    scored = rows.select("doc", model.score(quality_features("doc.text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    doc_id = F.col("doc.doc_id")
    return scored.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), "score", "predicted")
