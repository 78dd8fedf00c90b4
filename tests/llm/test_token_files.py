import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleanery.llm import token_files
from gleanery.llm.token_files import Encoder, TokenStore, perfect_hash, stored_documents, write_store, _bucket_seeds, _slots
from gleanery.session import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_is_the_tokenizer():
    own = Encoder(PATH)
    texts = ["", "a", " a", "a ", "a  b", "a \nb", "a\n b", "\n\na", "a\n", "x<|endoftext|>y z", "it's don't  we'll",
             "a\r\nb c", "a\x1c b", "\t\tq", "é è  u", "one\ntwo three\nfour", "\na", "z　z", "a\u0085b", "\0\na b", "#"]
    for _ in range(2):
        got = [np.frombuffer(raw, "<u2").tolist() for raw in own.encode(texts)]
        assert got == [ids(t) for t in texts]


def test_round_trip_with_nulls_and_repeats(odd_docs, no_docs):
    got = stored_documents(odd_docs).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    expected = sorted((str(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert stored_documents(no_docs).count() == 0


def test_keyed_access(spark):
    docs = spark.createDataFrame([(k * 7 - 50, f"text number {k} " * (k % 5)) for k in range(300)], "doc_id long, text string")
    path = scratch_dir(spark, "store")
    store = write_store(docs, path, PATH)
    assert isinstance(store, TokenStore)
    wanted = spark.createDataFrame([(-50,), (6,), (5,), (10**15,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in store.documents(wanted).collect()}
    assert got == {-50: ids(""), 6: ids("text number 8 " * 3)}


def test_perfect_hash_is_minimal():
    for n in (1, 2, 5, 1000):
        keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 5 * 10**11
        seeds = perfect_hash(keys)
        assert sorted(_slots(keys, _bucket_seeds(keys, seeds), n)) == list(range(n))


def test_repeated_ids_go_on_over_blocks_and_shards(spark, monkeypatch):
    """One id holds half of the rows, in blocks of few ids; the records of a block share it."""
    from gleanery.llm import token_files

    monkeypatch.setattr(token_files, "BLOCK_IDS", 40)
    docs = spark.range(0, 400, 1, 4).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "concat('text ', id, ' and more') as text")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stored_documents(docs).collect())
    want = [(r["doc_id"], ids(r["text"])) for r in docs.collect()]
    assert got == sorted((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in want)


def test_records_are_read_where_the_index_says(spark):
    """With a spoilt offset, block or shard a key reads nothing; its neighbours are not read."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id long, text string")
    store = write_store(docs, scratch_dir(spark, "store"), PATH)
    places = store.lookup(docs)
    assert store.records(places).count() == 50
    for column in ("position", "block", "shard"):
        spoilt = places.withColumn(column, F.when(F.col("doc_id") == 20, F.col(column) + 1).otherwise(F.col(column)))
        assert {r["doc_id"] for r in store.records(spoilt).collect()} == set(range(50)) - {20}


def test_perfect_hash_mixes_the_keys_once(monkeypatch):
    calls = []
    mix = token_files._hash
    monkeypatch.setattr(token_files, "_hash", lambda keys, seed: calls.append(seed) or mix(keys, seed))
    keys = np.arange(3000) * 7 - 500
    seeds = token_files.perfect_hash(keys)
    assert len(calls) <= 3
    slots = token_files._slots(keys, token_files._bucket_seeds(keys, seeds), len(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))
