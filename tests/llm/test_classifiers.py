import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleanery.llm import preference, toxicity
from gleanery.llm.preference import preference_pairs, score_quality
from gleanery.llm.registry import QUERIES
from gleanery.llm.toxicity import Lexicon, drop_toxic, features_of, score_toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    scored = QUERIES[query](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return scored, scored.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("label")).collect()


def ranked_right(rows):
    ones = [r["score"] for r in rows if r["label"]]
    zeros = [r["score"] for r in rows if not r["label"]]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("query, label, cut", [("op1_quality", "quality", 0.3), ("op4_toxicity", "toxic", 0.5)])
def test_held_out_rows_are_told_apart(spark, query, label, cut):
    scored, rows = held_out(spark, query, label)
    assert ranked_right(rows) > 0.9
    assert sum(r["predicted"] == r["label"] for r in rows) / len(rows) > 0.93
    assert scored.where(f"score is null or score < 0 or score > 1 or predicted <> cast(score >= {cut} as int)").count() == 0
    wrong_fold = scored.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert wrong_fold.count() == 0 and scored.count() == 1000


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs, score):
    label = "quality" if score is score_quality else "toxic"
    labels = spark.createDataFrame(
        [(1, 1, 1), (2, 0, 0), (6, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (4, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    for known in labels, labels.limit(0), labels.where(f"{label} = 1"):
        rows = score(odd_docs, known).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert list(rows[0]["doc"].asDict()) == odd_docs.columns
    assert score(no_docs, labels).count() == 0


def test_every_document_meets_others(spark):
    rows = [(1, [float(k)], k) for k in range(7)] + [(0, [float(-k)], k) for k in range(1, 4)]
    pairs = preference_pairs(spark.createDataFrame(rows, "label int, x array<double>, key long"), 2).collect()
    assert len(pairs) == 14 and all(r["d"][0] > 0 for r in pairs)


def test_quality_features_of_odd_texts():
    for text in ["", " \n", "a", "|" * 50, "x " * 5000, "漢字 😀", "\0"]:
        assert len(preference.features_of(text)) == len(preference.FEATURES)


def test_toxic_features():
    lexicon = Lexicon({"idiot": 5.0, "grob*": 3.0})

    def of(text):
        return dict(zip(toxicity.FEATURES, features_of(text, lexicon)))

    assert of("you IDIOT!")["hits"] == 1 and of("you IDIOT!")["near_second_person"] == 0.5
    assert of("grobian here")["weight_sum"] == 3.0 and of("idiotic")["hits"] == 0
    assert of("you 1d10t")["trick_hits"] == 1 and of("i d i o t they said")["trick_hits"] == 1
    assert set(of("").values()) == {0.0} and of("***")["hits"] == 0


def test_the_gap_to_a_person_is_exact_in_long_texts():
    def near(text):
        return dict(zip(toxicity.FEATURES, features_of(text, Lexicon({"idiot": 5.0}))))["near_second_person"]

    assert near("idiot " * 200 + "word " * 99 + "you " * 200) == near("you " * 200 + "word " * 99 + "idiot " * 200) == 1 / 101
    rng = random.Random(6)
    for _ in range(200):
        words = rng.choices(["idiot", "you", "word"], [1, 1, 8], k=rng.randrange(2, 30))
        places = {w: [k for k, x in enumerate(words) if x == w] for w in words}
        gaps = [abs(i - j) for i in places.get("idiot", []) for j in places.get("you", [])]
        assert near(" ".join(words)) == (1 / (1 + min(gaps)) if gaps else 0.0)


def test_planted_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(4)
    base = [r["text"] for r in docs.where("lang = 'en' and length(text) between 200 and 2000").orderBy("doc_id").limit(30).collect()]
    bad = ["idiot", "moron", "stupid", "scum", "pathetic", "worthless", "disgusting", "trash", "clown", "loser"]
    rows = []
    for k, text in enumerate(base):
        own = text.split(" ")
        for _ in range(6):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((10**6 + k, " ".join(own), "en", "src0", len(text)))
    planted = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = drop_toxic(planted, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 1000000").count() <= 2
    clean = labels.where("toxic = 0").join(docs, "doc_id")
    assert kept.join(clean.select("doc_id"), "doc_id").count() >= 0.98 * clean.count()


# The pattern as it was before runs of letters and signs were taken whole.
SLOW_TRICK = re.compile(
    r"[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)+[0-9@$!|]*|[0-9@$!|]+[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)*"
)


def test_tricks_are_found_as_before():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choices("abé1@$!|*._- \n0", k=rng.randrange(40)))
        assert toxicity._TRICK.findall(text) == SLOW_TRICK.findall(text), text


@pytest.mark.parametrize("text", ["a" * 10**6 + " x1y", "1" * 10**6 + " x1y", "a." * 5 * 10**5 + " x1y", ".1" * 5 * 10**5 + "a", "a" + "." * 10**6 + " x1y"])
def test_long_words_take_linear_time(text):
    began = time.process_time()
    features_of(text, Lexicon({"bad": 1.0}))
    assert time.process_time() - began < 3


def test_letters_of_other_scripts_are_no_marks():
    place = preference.FEATURES.index("marks")
    english = "The boat came in late, and everyone on the pier was glad to see it."
    russian = "Лодка пришла поздно, и все на причале были рады её увидеть."
    greek = "Η βάρκα ήρθε αργά, και όλοι στην προβλήτα χάρηκαν που την είδαν."
    hindi = "नाव देर से आई, और घाट पर सब उसे देखकर खुश हुए."
    share = preference.features_of(english)[place]
    for text in (russian, greek, hindi):
        assert abs(preference.features_of(text)[place] - share) < 0.03
    capitals = preference.FEATURES.index("capitals")
    assert preference.features_of("ЛОДКА ПРИШЛА")[capitals] > 0.9
