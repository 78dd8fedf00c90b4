"""Packing: the reduction loses nothing, every token has one place, sequences are few."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gleanery.llm import packing
from gleanery.llm.packing import END_ID, _Lengths, best_fit, pack, packed_sequences, plan, reduce, token_pieces
from gleanery.llm.registry import QUERIES
from gleanery.llm.word_codes import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The least number of sequences, by trying every subset with the first piece."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)

        def extend(room, at, kept):
            nonlocal best
            best = min(best, 1 + need(tuple(kept + list(rest[at:]))))
            for k in range(at, len(rest)):
                if rest[k] <= room:
                    extend(room - rest[k], k + 1, kept + list(rest[at:k]))

        extend(capacity - first, 0, [])
        return best

    return need(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    left = _Lengths(Counter(lengths))
    fixed = reduce(left, 20)
    assert all(sum(found) <= 20 for found, _ in fixed)
    rest = list(Counter(left.count).elements())
    taken = Counter(w for found, times in fixed for w in found * times)
    assert taken + Counter(rest) == Counter(lengths)
    assert sum(times for _, times in fixed) + fewest(rest, 20) == fewest(lengths, 20)


def test_reduction_of_three():
    left = _Lengths(Counter([50, 26, 24, 23]))
    assert reduce(left, 100) == [((50, 26, 24), 1), ((23,), 1)]


def _best_fit_one_by_one(lengths, capacity):
    rooms = []
    for w in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - w)
    return rooms


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_best_fit_equals_piece_by_piece(lengths):
    made = best_fit(_Lengths(Counter(lengths)), 30)
    rooms = [30 - sum(w * n for w, n in held) for held, times in made for _ in range(times)]
    assert sorted(rooms) == sorted(_best_fit_one_by_one(lengths, 30))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 10_000), max_size=40))
def test_plan_has_a_place_for_every_piece(counts):
    slots = plan(counts, 64)
    total = sum(w * n for w, n in counts.items())
    held = defaultdict(int)
    for row, after in zip(slots.tolist(), slots[1:].tolist() + [[None]]):
        w, first, sequence, copies, offset = row
        last = after[1] if after[0] == w else counts[w]
        assert offset + copies * w <= 64 and (last - first) % copies == 0
        held[sequence] += w * copies
    assert set(slots[:, 0].tolist()) == {w for w, n in counts.items() if n}
    assert len(slots) <= 64 * 8
    if total:
        assert max(held.values()) <= 64


def read(rows):
    """Ids of each document of the packed rows, with every check of the places."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return held


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_odd_documents(request, spark, name):
    docs = request.getfixturevalue(name)
    rows = pack(token_pieces(docs, WORDS)).collect()
    read(rows)
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [END_ID]
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            own = np.array(ids[start : start + packing.CAPACITY], "<u4")
            want[r["doc_id"], piece, start, len(own), own.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want


def test_large_ids_beside_null(spark):
    docs = spark.createDataFrame([(2**60 + k if k else None, "a b") for k in range(5)], "doc_id long, text string")
    rows = pack(token_pieces(docs.coalesce(1), WORDS)).collect()
    assert {r["doc_id"] for r in rows} == {None, *(2**60 + k for k in range(1, 5))}


def test_many_equal_lengths(spark):
    """A length that holds nearly all rows over several parts."""
    docs = spark.range(0, 30_000, 1, 6).selectExpr("id as doc_id", "if(id % 10 = 0, 'one more word here', 'same') as text")
    rows = pack(token_pieces(docs, WORDS), 64).collect()
    total = sum(r["length"] for r in rows)
    held = defaultdict(int)
    for r in rows:
        held[r["sequence_id"]] += r["length"]
    assert len(rows) == 30_000 and max(held.values()) <= 64 and len(held) == -(-total // 64)


def test_sequences_hold_their_documents(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * (k + 1)) for k in range(40)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(WORDS)
    found = {}
    for r in packed_sequences(docs, WORDS, 64).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == sum(p["length"] for p in r["pieces"]) <= 64
        for p in r["pieces"]:
            found[p["doc_id"], p["start"]] = ids[p["offset"] : p["offset"] + p["length"]]
    for k in range(40):
        own = [i for key in sorted(x for x in found if x[0] == k) for i in found[key]]
        assert own == tokenizer.encode(f"word{k} " * (k + 1), add_special_tokens=False).ids + [END_ID]


TEXTS = st.lists(st.text(alphabet="aZ9'.,é漢́Σ\x00<|> \n\t\xa0  ", max_size=30), max_size=6)


@settings(max_examples=40, deadline=None)
@given(TEXTS)
@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_give_the_ids_of_the_text(path, texts):
    encoder = ENCODERS.setdefault(path, WordEncoder(path))
    assert encoder.by_words
    texts = texts + ["x<|endoftext|>y", "<|end", "a b\nc d", None]
    found = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [f.tolist() for f in found] == want


ENCODERS = {}


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers.pre_tokenizers import ByteLevel

    other = Tokenizer.from_file(BYTES)
    other.pre_tokenizer = ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    encoder = WordEncoder(str(tmp_path / "other.json"))
    assert not encoder.by_words
    found = encoder.encode(pa.array(["a b", "c"]))
    assert [f.tolist() for f in found] == [other.encode(t, add_special_tokens=False).ids for t in ("a b", "c")]


def test_query(spark):
    import duckdb

    rows = QUERIES["op11_packing"](spark, "/root/testdata/sf0.001").collect()
    read(rows)
    tokenizer = Tokenizer.from_file(WORDS)
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want = {}
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[key, piece] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1


def test_words_of_letters_are_encoded_as_they_come(monkeypatch):
    """Only other words are made into the form they have in a text, and once."""
    encoder, made = WordEncoder(BYTES), []
    form = encoder._in_text
    monkeypatch.setattr(encoder, "_in_text", lambda words: made.extend(words) or form(words))
    texts = ["some words, some\nlines ab12", "words again ab12 words", "été ab12"]
    for _ in range(2):
        found = encoder.encode(pa.array(texts))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids.tolist() for ids in found] == want
    assert made.count("ab12") == 1 and not {"some", "again"} & set(made)


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    """Also in later runs; and in no more than the bound are words remembered."""
    for path in WORDS, BYTES:
        encoder, coded = WordEncoder(path), []
        codes = encoder._codes
        monkeypatch.setattr(encoder, "_codes", lambda words: coded.extend(words) or codes(words))
        for texts in (["a word, worth it."], ["worth a word; it's été, (word)"], ["word! x<|endoftext|>y, İ, e\u0301, <|end"]):
            found = encoder.encode(pa.array(texts))
            want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert [ids.tolist() for ids in found] == want
        assert coded.count("word") == 1 and coded.count("worth") == 1 and coded.count("été") == 1


def test_remembered_words_are_bounded(monkeypatch):
    from gleanery.llm import word_codes

    monkeypatch.setattr(word_codes, "KNOWN_WORDS", 20)
    encoder = WordEncoder(BYTES)
    for run in range(12):
        texts = [" ".join(f"{stem}{'x' * (run * 3 + k)}," for k in range(3) for stem in ("some", "other")) + " stay, stay"]
        found = encoder.encode(pa.array(texts))
        assert found[0].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert len(encoder.known) <= 20
    assert "stay" in encoder.known.to_pylist()
