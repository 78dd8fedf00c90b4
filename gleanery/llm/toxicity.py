"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Which words are abusive is learned from the labelled documents: words, and beginnings of
words, that stand in toxic documents and hardly in others. The features of a text are
densities of these, their nearness to words of the second person, capitals, marks,
and hits that appear only after spelling tricks are undone. To train the trees, the
lexicon that reads a document is learned without the documents of its own fold, so
that training texts look to the trees as new texts will.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanery.llm.common import fold, given_back, packed, table
from gleanery.llm.labelled import training_sample
from gleanery.session import written

TREES = 20
DEPTH = 3
# A term of the lexicon stands in this many toxic documents, in so many times the share.
LEAST_DOCUMENTS = 3
LEAST_RATIO = 8.0
MOST_TERMS = 2000
# Terms are whole words, or beginnings of words of these lengths (marked by *).
BEGINNINGS = (4, 5, 6, 7, 8)
CUT_SCORE = 0.5
# Calibrated scores of equal height are told apart by a small share of the trees' own.
OWN_SHARE = 1e-3

# Words of the second person, and letters that signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos ti tú "
    "usted ustedes vosotros os".split()
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

_WORD = re.compile(r"[^\W_]+")
# A start inside a run of letters or signs gives what the start of the run gives, so only that
# is tried, and runs are not given back: any text takes linear time.
_TRICK = re.compile(
    r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*._\-]++[^\W\d_]++)+[0-9@$!|]*+"
    r"|(?<![0-9@$!|])[0-9@$!|]++[^\W\d_]++(?:[0-9@$!|*._\-]++[^\W\d_]++)*"
)
_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_]){3,}\w(?!\S)")
_SEPARATORS = re.compile(r"[*._\-\s]+")

FEATURES = [
    "hits", "hit_share", "weight_sum", "weight_most", "distinct_hits", "near_second_person",
    "second_person_share", "capitals", "sentence_ends", "marks", "shouts", "tricks", "trick_hits", "log_words",
]


class Lexicon:
    """Weights of whole words and of beginnings."""

    def __init__(self, terms: dict[str, float]):
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.starts = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.heads = {t[:4] for t in (*self.words, *self.starts)}
        self.lengths = sorted({len(t) for t in self.starts})

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                best = max(best, self.starts.get(word[:n], 0.0))
        return best


def _least_gap(some: list[int], others: list[int]) -> int:
    """The least distance between two sorted lists of places, neither of them empty."""
    i = j = 0
    least = abs(some[0] - others[0])
    while i < len(some) and j < len(others):
        least = min(least, abs(some[i] - others[j]))
        if some[i] < others[j]:
            i += 1
        else:
            j += 1
    return least


def features_of(text: str, lexicon: Lexicon) -> list[float]:
    """The features of a whole text; zeros for an empty one."""
    lower = text.lower()
    words = _WORD.findall(lower)
    if not text.strip():
        return [0.0] * len(FEATURES)
    n = max(len(words), 1)
    heads, weight = lexicon.heads, lexicon.weight
    found = [(i, w, weight(w)) for i, w in enumerate(words) if w[:4] in heads]
    hits = [(i, w, x) for i, w, x in found if x > 0]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0.0
    if hits and persons:
        near = 1 / (1 + _least_gap([i for i, _, _ in hits], persons))
    tricks, trick_hits = 0, 0
    if hits or _has_tricks(lower):
        plain = {w for _, w, _ in hits}
        for match in (*_TRICK.findall(lower), *_SPACED.findall(lower)):
            word = _SEPARATORS.sub("", match.translate(SIGNS))
            tricks += 1
            trick_hits += word not in plain and weight(word) > 0
    letters = sum(map(len, words)) or 1
    upper = sum(map(text.count, filter(str.isupper, set(text))))
    return [
        float(len(hits)),
        len(hits) / n,
        sum(x for _, _, x in hits),
        max((x for _, _, x in hits), default=0.0),
        float(len({w for _, w, _ in hits})),
        near,
        len(persons) / n,
        upper / letters,
        sum(map(text.count, (". ", "! "))) / n,
        sum(map(text.count, "!?*$%&#@")) / len(text),
        text.count("!") / n,
        tricks / n,
        float(trick_hits),
        math.log1p(n),
    ]


_SIGN = re.compile(r"[^\W\d_][0-9@$!|*._\-]+[^\W\d_]|[0-9@$!|][^\W\d_]|(?<!\S)\w[ .\-_]\w[ .\-_]\w[ .\-_]")


def _has_tricks(lower: str) -> bool:
    return _SIGN.search(lower) is not None


def toxic_features(lexicons):
    """Features by the lexicon of the given number (0: learned from all folds)."""

    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = [Lexicon(terms) for terms in lexicons.value]
        for texts, which in given_back(batches):
            rows = [features_of(t or "", known[k]) for t, k in zip(texts.to_pylist(), which.to_pylist())]
            yield pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(read, "array<double>")


@F.arrow_udf(ArrayType(StringType()))
def distinct_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct words of four letters or more and their beginnings."""
    for texts in given_back(batches):
        rows = []
        for text in texts.to_pylist():
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= BEGINNINGS[0]}
            starts = {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}
            rows.append(list(words | starts))
        yield pa.array(rows, pa.list_(pa.string()))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons of the bounded sample: number 0 from all folds, k without fold k.

    A term's weight is the logarithm of its share among toxic documents over that among
    others. Shorter beginnings whose words are not toxic on the whole fall out by
    themselves; at most MOST_TERMS of the best stay.
    """
    totals = sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    terms = sample.select("fold", "label", F.explode(distinct_terms("text")).alias("term"))
    counts = terms.groupBy("term").agg(
        *(F.sum(((F.col("fold") == k) & (F.col("label") == y)).cast("long")).alias(f"n{k}{y}") for k in range(1, 5) for y in (0, 1))
    )
    counts = written(counts.where(" + ".join(f"n{k}1" for k in range(1, 5)) + f" >= {LEAST_DOCUMENTS}"), "terms")
    lexicons = []
    for without in range(5):
        folds = [k for k in range(1, 5) if k != without]
        size = {y: sum(r["n"] for r in totals if r["fold"] in folds and r["label"] == y) for y in (0, 1)}
        toxic = sum((F.col(f"n{k}1") for k in folds), F.lit(0))
        other = sum((F.col(f"n{k}0") for k in folds), F.lit(0))
        weight = F.log((toxic + 0.5) / (size[1] + 1)) - F.log((other + 0.5) / (size[0] + 1))
        best = counts.where((toxic >= LEAST_DOCUMENTS) & (weight >= math.log(LEAST_RATIO)))
        # Few counts make large ratios: terms seen seldom must be the clearer.
        best = best.select("term", (weight * (1 - 1 / toxic)).alias("weight"), weight.alias("raw"), toxic.alias("n"))
        best = best.where(F.col("raw") >= math.log(LEAST_RATIO) + 3 / F.col("n"))
        best = best.orderBy(F.desc("weight"), "term").limit(MOST_TERMS)
        lexicons.append({r["term"]: r["weight"] for r in best.collect()})
    return lexicons


class Toxicity:
    """A fitted model: lexicons, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        """`rows` (one struct `doc`) with score and predicted."""
        if self.trees is None:
            scored = rows.select("doc", F.lit(0.0).alias("score"))
        else:
            shared = rows.sparkSession.sparkContext.broadcast([self.lexicon])
            features = toxic_features(shared)(F.col(text), F.lit(0))
            judged = self.trees.transform(rows.select("doc", array_to_vector(features).alias("features")))
            own = vector_to_array("probability")[1]
            judged = judged.select("doc", own.alias("own"))
            if self.calibration is not None:
                judged = self.calibration.transform(judged)
            else:
                judged = judged.withColumn("calibrated", F.col("own"))
            mixed = (1 - OWN_SHARE) * F.col("calibrated") + OWN_SHARE * F.col("own")
            scored = judged.select("doc", F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))


def fit(sample: DataFrame) -> Toxicity:
    """Learn from rows of fold, label and text (a bounded sample).

    The trees learn from folds 1 to 3 and the calibration from fold 4. With one label
    alone there is nothing to learn: all scores are 0; without both in fold 4 the
    trees' own probabilities are the scores.
    """
    spark = sample.sparkSession
    sample = written(sample, "labelled")
    lexicons = learn_lexicons(sample)
    shared = spark.sparkContext.broadcast(lexicons)
    features = toxic_features(shared)(F.col("text"), F.col("fold"))
    rows = sample.select("fold", F.col("label").cast("double").alias("label"), array_to_vector(features).alias("features"))
    rows = written(rows, "toxic_features")
    both = {r["fold"]: r["n"] for r in rows.groupBy((F.col("fold") == 4).alias("fold")).agg(F.countDistinct("label").alias("n")).collect()}
    if both.get(False, 0) < 2:
        return Toxicity(lexicons[0], None, None)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=4, maxBins=64)
    trees = learner.fit(rows.where("fold < 4"))
    calibration = None
    if both.get(True, 0) == 2:
        held = trees.transform(rows.where("fold = 4")).select("label", vector_to_array("probability")[1].alias("own"))
        calibration = IsotonicRegression(featuresCol="own", predictionCol="calibrated").fit(held)
    return Toxicity(lexicons[0], trees, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: its columns as the struct `doc`, score and predicted.

    Null and empty texts have zero features. Nothing but the text is an input. Repeated
    rows are scored each.
    """
    model = fit(training_sample(docs, labels, "toxic"))
    return model.score(docs.select(packed(docs).alias("doc")), "doc.text")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    return score_toxicity(docs, labels).where("predicted = 0").select("doc.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    doc_id = F.col("doc.doc_id")
    return scored.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), "score", "predicted")
