"""The manifest against a tree built node by node with hashlib."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gleanery.llm import merkle
from gleanery.llm.merkle import build_manifest, leaf_of
from gleanery.llm.midstates import bytes_state, compress, ended, hex_block, started, state_bytes
from gleanery.llm.registry import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """The root, and for each node what stands left and right of its path, level by level."""
    sides = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(at, min(at + 3, len(nodes))) for at in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for own in under[k]:
                    sides[own].append(([nodes[i] for i in run if i < k], [nodes[i] for i in run if i > k]))
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
        under = [[own for k in run for own in under[k]] for run in runs]
    return nodes[0], sides


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of rows of (doc_id, text, source, lang, n)."""
    import zlib

    groups = defaultdict(list)
    for doc_id, text, source, lang, n in rows:
        own = leaf(doc_id, source, lang, n, text)
        odd = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = leaf(doc_id, source, lang, n, None if text is None else text.replace("\n", "")) if odd else own
        groups[source].append(((doc_id is not None, doc_id or 0, own), changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = [], []
    for source in order:
        held = sorted(groups[source])
        subroot, sides = climb([key[2] for key, _ in held])
        subroots.append(subroot)
        paths.append((held, sides))
    root, tops = climb(subroots)
    found = Counter()
    for (held, sides), subroot, top in zip(paths, subroots, tops):
        for (key, changed), own in zip(held, sides):
            digest, proof = changed, ""
            for left, right in own + top:
                digest = sha("".join(left) + digest + "".join(right))
                proof += "".join(left + right)
            found[key[1] if key[0] else None, key[2], subroot, root, sha(proof), digest, digest == root] += 1
    return found


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def run(spark, rows, tmp_path):
    kinds = "doc_id long, text string, source string, lang string, n_chars long"
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op12_manifest"](spark, folder).collect()
    return Counter(tuple(r[c] for c in COLUMNS) for r in found)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=9))
def test_resumed_states(digests):
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    state = started(1)
    for k in range(len(raw)):
        state = bytes_state(state_bytes(state))  # kept and taken up again
        state = compress(state, hex_block(raw[k : k + 1]))
    want = sha("".join(d.hex() for d in digests))
    assert ended(state, np.array([len(raw)])).tobytes().hex() == want


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_trees_of_every_shape(spark, tmp_path, monkeypatch, levels):
    """Groups of 1 to 40 leaves, and small segments so that several passes are needed."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SEGMENT", 3**levels)
    rows = [
        (100 * g + k, f"text\n{k}" if k % 3 else f"flat {k}", f"s{g}", "en", k)
        for g, size in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 40))
        for k in range(size)
    ]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_odd_rows(spark, tmp_path):
    """Null ids, sources and texts, repeated rows and ids, names that order by bytes."""
    rows = [
        (None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (None, None, "z", "en", 1),
        (2**60 + 1, "x\n", "é", "en", 2), (2**60 + 2, "x\n", "é", "en", 2), (3, "", "z", "", 0), (3, "\n", "z", "", 0),
        (3, "\n", "z", "", 0), (4, "long " * 50_000 + "\n", "Z", "en", None), (5, None, "", "en", 5), (-7, "b\n", "", "de", 3),
    ]
    got = run(spark, rows, tmp_path)
    assert got == expected(rows)
    assert sum(got.values()) == len(rows)


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == Counter()


def test_kept_manifest_folds_some_rows(spark, tmp_path):
    """A manifest read back folds a part of the rows, without the others."""
    rows = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    leaves = rows.select("id", "source", leaf_of(F.col("id"), F.col("text")).alias("leaf"))
    path = str(tmp_path / "manifest")
    build_manifest(leaves, F.col("source"), ["id"], path)
    manifest = merkle.Manifest.read(spark, path)
    some = manifest.leaves.where("id % 50 = 7").withColumn("other", F.unhex(F.sha2(F.lit("other"), 256)))
    same = manifest.fold(some).collect()
    assert len(same) == 10 and all(r["folded_root"] == r["root"] for r in same)
    changed = manifest.fold(some, "other").collect()
    assert len({r["folded_root"] for r in changed} | {r["root"] for r in changed}) == 11


def test_table_of_the_query(spark):
    import duckdb

    docs = duckdb.sql("select doc_id, text, source, lang, n_chars from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    found = QUERIES["op12_manifest"](spark, "/root/testdata/sf0.001").collect()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in found)
    assert got == expected(docs)
    assert {r["verified"] for r in found} == {True, False}
