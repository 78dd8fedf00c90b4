"""Benchmark decontamination with suffix arrays of the training documents.

The corpus is cut into shards (runs of consecutive documents inside a task). Each shard
gets an array of its suffixes in the order of their first ten words, and every suffix of
every benchmark item is searched in it by bisection. The equal range of a suffix is the
list of all places where it occurs, so hits, locations and longest verbatim matches
follow from the ranges. Nothing is shuffled: documents stay where they are read, and
the benchmark travels to them in blocks of bounded size.

A suffix can only equal a benchmark suffix if its first word, and its second where the
window has two, stand in the benchmark next to each other; other suffixes are left out
of the array before it is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.llm.common import given_back, packed, runs_of_texts, utf8_buffer
from gleanery.session import written

WINDOW = 10
# Bytes of text per suffix array, and of benchmark text per broadcast block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
# Blocks searched in one pass over the documents.
BLOCKS_PER_PASS = 4

# Polynomial word hashes modulo 2^64. They find candidates; every match is compared by bytes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Word bytes after lower-casing: digits, a to z, everything beyond ASCII.
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """Hash and document of every word in a run of texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        size = len(data)
        low = _LOWER[data]
        word = _IS_WORD[low]
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        before = np.concatenate(([False], word[:-1])) if size else word
        after = np.concatenate((word[1:], [False])) if size else word
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        terms = _BYTE_VALUE[low]
        terms *= _powers(_BASE, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        self.hash = (sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts] if size else sums[:0]
        self.low, self.starts, self.ends = low, starts, ends
        self.first = np.searchsorted(starts, bounds[:-1])
        self.count = np.diff(np.append(self.first, len(starts)))


class Benchmark:
    """The words of a block of items, its windows as search keys, and their items."""

    def __init__(self, ids: list[str], texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        words = Words(np.frombuffer(b"".join(raw), np.uint8), bounds)
        self.ids = ids
        self.words = {"low": words.low, "starts": words.starts, "ends": words.ends}
        self.vocabulary = np.unique(words.hash)
        number = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.uint32)
        spans = [
            (item, at, min(WINDOW, int(n)))
            for item, (first, n) in enumerate(zip(words.first, words.count))
            for at in range(int(first), int(first + max(n - WINDOW, 0)) + 1)
            if n
        ]
        low = np.zeros((len(spans), WINDOW), ">u4")
        high = np.full((len(spans), WINDOW), 0xFFFFFFFF, ">u4")
        for row, (_, at, n) in enumerate(spans):
            low[row, :n] = high[row, :n] = number[at : at + n]
        self.item = np.array([s[0] for s in spans], np.int64)
        self.at = np.array([s[1] for s in spans], np.int64)
        self.length = np.array([s[2] for s in spans], np.int64)
        self.low, self.high = _as_keys(low), _as_keys(high)
        # Pairs of neighbours by which a suffix may begin; windows of one word need none.
        pairs = [(int(number[at]) << 32) | int(number[at + 1]) for _, at, n in spans if n > 1]
        self.pairs = np.unique(np.array(pairs, np.uint64))
        self.single = np.unique([int(number[at]) for _, at, n in spans if n == 1])
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def of(fields: dict) -> Benchmark:
        """From its fields: a broadcast carries plain data only, as workers need not have
        this package."""
        made = Benchmark.__new__(Benchmark)
        made.__dict__.update(fields)
        return made


def _as_keys(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"S{4 * WINDOW}").ravel()


def _numbers(words: Words, bench: Benchmark) -> np.ndarray:
    """Vocabulary number of each word, 0 for words the benchmark has not."""
    numbers = np.zeros(len(words.hash), np.uint32)
    maybe = np.flatnonzero(bench.known[(words.hash >> np.uint64(48)).astype(np.int64)])
    hashes = words.hash[maybe]
    found = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
    same = bench.vocabulary[found] == hashes
    numbers[maybe[same]] = found[same] + 1
    return numbers


def _suffix_array(numbers: np.ndarray, last: np.ndarray, bench: Benchmark):
    """Positions of the suffixes that may match, in key order, and their keys."""
    following = np.append(numbers[1:], np.uint32(0))
    following[last] = 0
    pairs = (numbers.astype(np.uint64) << np.uint64(32)) | following
    begin = np.flatnonzero(np.isin(numbers, bench.single)) if len(bench.single) else np.zeros(0, int)
    both = np.flatnonzero((numbers > 0) & (following > 0))
    begin = np.union1d(begin, both[np.isin(pairs[both], bench.pairs)])
    keys = np.zeros((len(begin), WINDOW), ">u4")
    at, alive = begin.copy(), np.ones(len(begin), bool)
    ends = np.zeros(len(numbers), bool)
    ends[last] = True
    for k in range(WINDOW):
        keys[alive, k] = numbers[at[alive]]
        alive &= ~ends[np.minimum(at, len(numbers) - 1)] & (keys[:, k] > 0)
        at[alive] += 1
    keys = _as_keys(keys)
    order = np.argsort(keys, kind="stable")
    return begin[order], keys[order]


def _search(words: Words, bench: Benchmark):
    """All occurrences of all benchmark suffixes: (word position, window number)."""
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not len(bench.item):
        return none, none
    filled = words.count > 0
    last = (words.first + words.count - 1)[filled]
    suffixes, keys = _suffix_array(_numbers(words, bench), last, bench)
    left = np.searchsorted(keys, bench.low, "left")
    right = np.searchsorted(keys, bench.high, "right")
    many = np.maximum(right - left, 0)
    window = np.repeat(np.arange(len(many)), many)
    at = suffixes[left[window] + _within(many)]
    same = _same_words(words, at, window, bench)
    return at[same], window[same]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _same_words(words: Words, at: np.ndarray, window: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Whether the words of each match are equal byte by byte, not only by hash."""
    n = bench.length[window]
    step = _within(n)
    match = np.repeat(np.arange(len(n)), n)
    ours, theirs = at[match] + step, bench.at[window][match] + step
    # A word pair of several matches is compared once.
    pairs, which = np.unique(ours * len(bench.words["starts"]) + theirs, return_inverse=True)
    ours, theirs = np.divmod(pairs, max(len(bench.words["starts"]), 1))
    size = words.ends[ours] - words.starts[ours]
    equal = size == bench.words["ends"][theirs] - bench.words["starts"][theirs]
    size = np.where(equal, size, 0)
    byte = _within(size)
    pair = np.repeat(np.arange(len(size)), size)
    differs = words.low[words.starts[ours][pair] + byte] != bench.words["low"][bench.words["starts"][theirs][pair] + byte]
    equal[pair[differs]] = False
    good = np.ones(len(at), bool)
    good[match[~equal[which]]] = False
    return good


def _longest(doc, at, window, bench):
    """Per document the longest verbatim run: consecutive hits on one diagonal of one item."""
    if not len(doc):
        return {}
    diagonal = at - bench.at[window]
    item = bench.item[window]
    order = np.lexsort((at, diagonal, item, doc))
    doc, at, item, diagonal, length = (x[order] for x in (doc, at, item, diagonal, bench.length[window]))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) > 1)
    head = np.flatnonzero(new)
    size = at[np.append(head[1:], len(at)) - 1] - at[head] + length[head]
    best = np.lexsort((at[head], -size, doc[head]))
    docs, pick = np.unique(doc[head][best], return_index=True)
    rows = best[pick]
    return {int(d): (int(size[r]), int(at[head[r]]), int(item[head[r]])) for d, r in zip(docs, rows)}


HITS = (
    "n_words long, hits array<struct<from:int,to:int>>, items array<string>,"
    " longest struct<words:int,at:int,item:string>"
)


def _scan_run(data, bounds, bench: Benchmark) -> list[tuple]:
    words = Words(data, bounds)
    at, window = _search(words, bench)
    doc = np.searchsorted(words.first, at, "right") - 1
    longest = _longest(doc, at, window, bench)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + bench.length[window], -1)
    cover = np.cumsum(cover) > 0
    n_items = max(len(bench.ids), 1)
    pairs = np.unique(doc * n_items + bench.item[window])
    items: dict[int, list[str]] = {}
    for pair in pairs.tolist():
        items.setdefault(pair // n_items, []).append(bench.ids[pair % n_items])
    rows = []
    for d, (first, n) in enumerate(zip(words.first.tolist(), words.count.tolist())):
        if d not in items:
            rows.append((n, [], [], None))
            continue
        own = np.concatenate(([0], cover[first : first + n].view(np.int8), [0]))
        turns = np.flatnonzero(np.diff(own)).tolist()
        size, where, item = longest[d]
        hits = [{"from": a, "to": b} for a, b in zip(turns[::2], turns[1::2])]
        rows.append((n, hits, items[d], {"words": size, "at": where - first, "item": bench.ids[item]}))
    return rows


def _scanner(block):
    """A function over batches of texts; a batch is cut into shards of bounded size."""
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("hits", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
            ("items", pa.list_(pa.string())),
            ("longest", pa.struct([("words", pa.int32()), ("at", pa.int32()), ("item", pa.string())])),
        ]
    )

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = Benchmark.of(block.value)
        for texts in given_back(batches):
            data, bounds = utf8_buffer(texts)
            rows = []
            for first, last in runs_of_texts(bounds, SHARD_BYTES):
                own = bounds[first : last + 1]
                rows += _scan_run(data[own[0] : own[-1]], own - own[0], bench)
            names = ("n_words", "hits", "items", "longest")
            yield pa.array([dict(zip(names, r)) for r in rows], kind)

    return F.arrow_udf(scan, HITS)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[Benchmark]:
    """The items in blocks of about BLOCK_BYTES: as many blocks as the table needs."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for k in range(count):
        rows = items.where(block == k).toPandas().sort_values(["id", "text"])
        yield Benchmark(rows["id"].tolist(), rows["text"].tolist())


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Where benchmark windows occur in each document.

    A window is ten consecutive words of an item; an item of fewer words, but not none,
    is one window. Words are runs of ASCII letters (lower-cased), digits and characters
    beyond ASCII. Gives one row per document, with its columns as the struct `doc`:
    `n_words`, `hits` (word ranges inside occurrences, end exclusive, disjoint), `items`
    (ids of items with occurring windows, as sorted strings without repeats) and
    `longest` (words, at, item: the longest verbatim match, the first of equals).

    Null and empty texts have no words and no hits. Items without words match nothing;
    an item without an id counts under the empty id; items that repeat an id count once.
    An empty benchmark leaves every document clean. Repeated documents are judged each.
    """
    spark = docs.sparkSession
    rows = docs.select(packed(docs).alias("doc"))
    done: list[Column] = []
    state = None
    for number, bench in enumerate(_blocks(benchmark, item_id, item_text)):
        found = _scanner(spark.sparkContext.broadcast(vars(bench)))(F.col("doc").getField(text))
        rows = rows.withColumn(f"block_{number}", found)
        done.append(F.col(f"block_{number}"))
        if len(done) == BLOCKS_PER_PASS:
            rows = written(rows.select("doc", _merged(done, state).alias("state")), "matches")
            done, state = [], F.col("state")
    merged = rows.select("doc", _merged(done, state).alias("state"))
    return merged.select("doc", "state.*")


def _merged(found: list[Column], state: Column | None) -> Column:
    """One result of the results of several blocks."""
    found = ([] if state is None else [state]) + found
    if len(found) == 1:
        return found[0]
    hits = F.array_sort(F.flatten(F.array(*(f["hits"] for f in found))))
    start = F.array().cast("array<struct<from:int,to:int>>")

    def join(done: Column, hit: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["from"].alias("from"), F.greatest(last["to"], hit["to"]).alias("to"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["to"] < hit["from"])
        return F.when(apart, F.concat(done, F.array(hit))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        )

    longest = F.array_sort(
        F.array_compact(F.array(*(f["longest"] for f in found))),
        lambda a, b: F.when(a["words"] != b["words"], b["words"] - a["words"]).otherwise(a["at"] - b["at"]),
    )
    return F.struct(
        found[0]["n_words"].alias("n_words"),
        F.aggregate(hits, start, join).alias("hits"),
        F.flatten(F.array(*(f["items"] for f in found))).alias("items"),
        F.try_element_at(longest, F.lit(1)).alias("longest"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return match_benchmark(docs, benchmark).where(F.size("hits") == 0).select("doc.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark."""
    from gleanery.llm.common import table

    found = match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["to"] - h["from"])
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.col("longest.words"), F.lit(0)).alias("longest_words"),
        F.col("longest.at").alias("longest_at"),
        F.col("longest.item").alias("longest_item"),
    )
