"""Packed products are exact; mined rows equal a plain search over all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import hard_negatives as hn
from gleanery.llm.registry import QUERIES


@settings(max_examples=150, deadline=None)
@given(
    st.integers(1, 6), st.sampled_from([1, 7, 256, 10**4, 10**7, 10**9]),
    st.lists(st.integers(0, 2**32), min_size=2, max_size=7), st.data(),
)
def test_products_are_exact(width, size, seeds, data):
    component = st.integers(-size, size)
    rows = st.lists(st.lists(component, min_size=width, max_size=width), min_size=1, max_size=7)
    a, x = np.array(data.draw(rows), np.int64), np.array(data.draw(rows), np.int64)
    want = (a.astype(object) @ x.astype(object).T).tolist()
    assert hn.products(a, x).tolist() == want


def test_fields_follow_the_components():
    small, large = np.array([[0, 3], [1, 2]]), np.array([[0, 2**30]])
    assert hn.EXACT_BITS // hn.field_bits(small, small) > 8
    assert hn.EXACT_BITS // hn.field_bits(large, large) == 0
    wide = hn.pack_fields(np.array([[1, 2], [3, 4], [5, 6]]), 2, 10)
    assert wide.tolist() == [[1 + (3 << 10), 2 + (4 << 10)], [5, 6]]


def test_products_beyond_64_bits():
    with pytest.raises(OverflowError):
        hn.products(np.array([[2**62]]), np.array([[4]]))


def expected(rows):
    """rows of (vec_id, embedding, label)."""
    whole = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id % 7 == 0 else label
        whole.append((vec_id, moved, [math.floor(256 * float(np.float32(x))) for x in vector]))
    found = Counter()
    for a_id, a_label, a in whole:
        if a_id % 50:
            continue
        scored = [(sum(p * q for p, q in zip(a, v)), i, label) for i, label, v in whole]
        alike = sorted(((-s, i) for s, i, label in scored if label == a_label and i != a_id))[:5]
        for minus, p_id in alike:
            p = -minus
            inside = [(-s, i) for s, i, label in scored if label != a_label and 50 * p <= 100 * s <= 95 * p]
            for rank, (s, i) in enumerate(sorted(inside)[:3], 1):
                found[a_id, p_id, rank, i, p, -s] += 1
    return found


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def run(spark, rows, tmp_path):
    folder = str(tmp_path / "tables")
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string, score double")
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    found = QUERIES["op13_hard_negatives"](spark, folder).collect()
    return Counter(tuple(r[c] for c in COLUMNS) for r in found)


def test_mining(spark, tmp_path, monkeypatch):
    """Several shards and blocks, ties, and a label that holds half of the rows."""
    monkeypatch.setattr(hn, "SHARD_ROWS", 64)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        vector = [float(x) for x in np.round(rng.normal(size=4), 1)]
        rows.append((k, vector, int(rng.integers(0, 10)) if k % 2 else 4, "s", 0.5))
    got = run(spark, rows, tmp_path)
    assert got == expected([r[:3] for r in rows]) and len(got) > 30


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (3, [0.75, 0.25], 2), (4, [0.5, 0.75], 3),
        (4, [0.5, 0.75], 3), (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (8, None, 1), (9, [1.0, None], 1), (None, [1.0, 1.0], 1),
        (10, [1.0, 1.0], None), (50, [], 1), (100, [0.5], 2), (150, [-1.0, -1.0], 2), (200, [0.0, 0.0], 3), (250, [3.0] * 9, 77),
        *[(11, [0.9, 0.9], 1)] * 9, *[(12, [0.7, 0.6], 9)] * 9,
    ]
    got = run(spark, [(*r, "s", None) for r in rows], tmp_path)
    assert got == expected(rows) and got


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == Counter()


def test_repeated_anchor_ids_ask_once(spark):
    rows = spark.createDataFrame(
        [(0, 1, [9, 1]), (0, 1, [2, 5]), (1, 1, [4, 4]), (2, 2, [3, 3]), (3, 2, [2, 2])],
        "vec_id long, label int, vector array<long>",
    )
    found = hn.hard_negatives(rows, rows.where("vec_id = 0")).collect()
    assert [(r["positive_id"], r["positive_score"], r["negative_id"], r["negative_score"]) for r in found] == [
        (1, 28, 2, 21), (1, 28, 3, 14)
    ]


def test_query_against_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    result = connection.execute(hn.OP13_SQL)
    names = [d[0] for d in result.description]
    want = Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in result.fetchall())
    got = Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_hard_negatives"](spark, folder).collect())
    assert got == want and got
