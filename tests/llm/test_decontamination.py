import re

import numpy as np
import pytest

from gleanery.llm import suffix_arrays
from gleanery.llm.suffix_arrays import Benchmark, decontaminate, match_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add("" if item is None else str(item))
    found = []
    for i, text in docs:
        own, hit, ids = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if here := windows.get(tuple(own[k : k + n])):
                    ids |= here
                    hit.update(range(k, k + n))
        found.append((i, len(own), len(hit), tuple(sorted(ids))))
    return sorted(found, key=str)


def answers(found):
    return sorted(
        (
            (r["doc"]["doc_id"], r["n_words"], sum(h["to"] - h["from"] for h in r["hits"]), tuple(sorted(set(r["items"]))))
            for r in found.collect()
        ),
        key=str,
    )


ITEMS = [
    (1, "two THREE four five six seven eight nine ten eleven"),
    (2, "Word5 word6, word7"),
    (3, "another"),
    (3, "quite unlike the first"),
    (None, "漢字 😀 mixed lines"),
    (4, None),
    (5, "..."),
    (6, " ".join(f"word{k % 977}" for k in range(940, 1000))),
]


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_matches_brute_force(spark, odd_docs, monkeypatch, block_bytes):
    monkeypatch.setattr(suffix_arrays, "BLOCK_BYTES", block_bytes)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert answers(match_benchmark(odd_docs, items)) == brute(rows, ITEMS)


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "x y " + ITEMS[-1][1] + " z")], "doc_id long, text string")
    items = spark.createDataFrame([(6, ITEMS[-1][1])], "item_id long, text string")
    row = match_benchmark(docs, items).first()
    assert row["longest"].asDict() == {"words": 60, "at": 2, "item": "6"}
    assert [h.asDict() for h in row["hits"]] == [{"from": 2, "to": 62}]


def test_empty_tables_and_columns(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert match_benchmark(no_docs, items).count() == 0
    kept = decontaminate(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    left = {r["doc_id"] for r in decontaminate(odd_docs, items).collect()}
    assert left == {3, 4, 5, 7, None}


def test_shards_do_not_join_documents():
    bench = Benchmark(["1"], ["a b"])
    data = np.frombuffer(b"x aby a b", np.uint8)
    rows = suffix_arrays._scan_run(data, np.array([0, 3, 5, 7, 9]), bench)
    assert [r[0] for r in rows] == [2, 1, 1, 1] and not any(r[1] for r in rows)


def _thue_morse(letter, other, n):
    word = letter
    while len(word) < n:
        word += word.translate(str.maketrans({letter: other, other: letter}))
    return word


def test_words_of_equal_hash_are_not_equal(spark):
    """Words that collide under every polynomial hash modulo 2^64."""
    one, two = _thue_morse("a", "b", 2048), _thue_morse("b", "a", 2048)
    words = suffix_arrays.Words(np.frombuffer(f"{one} {two}".encode(), np.uint8), np.array([0, 4097]))
    assert words.hash[0] == words.hash[1]
    bench = spark.createDataFrame([("x", one), ("y", "five words and " + one)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"is {two} here"), (2, f"is {one} here"), (3, f"five words and {two}"), (4, f"FIVE words, and {one}!")], "doc_id long, text string")
    found = {r["doc"]["doc_id"]: (r["hits"], sorted(r["items"])) for r in match_benchmark(docs, bench).collect()}
    assert {k: items for k, (_, items) in found.items()} == {1: [], 2: ["x"], 3: [], 4: ["x", "y"]}
