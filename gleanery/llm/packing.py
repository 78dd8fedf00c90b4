"""Packing by Martello-Toth dominance reduction, then best fit.

How many pieces have which length is all that a packing depends on, and lengths are at most
the capacity. So the instance is a histogram of at most `capacity` rows, whatever the
number of documents, and the reduction and the fit work on lengths with counts:

1. Reduction. For a piece j, a set of few pieces dominates if any other set that fits with j
   could be exchanged for it without loss. Such sequences are fixed, as many at once as there
   are copies, and the rest is reduced again until nothing is dominated any more.
2. Best fit, longest pieces first, of what is left. Sequences with the same contents are
   one group with a count.

The plan, slots of lengths in groups of sequences, is as small as the histogram. Each piece
knows how many pieces of its length came before it, from its place in the written table and
the counts of the earlier parts of it, and takes the slot of that number. So no group of
equal lengths is ever in one task, and the ids of the pieces do not move.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import table
from gleanery.llm.word_codes import encoded_runs
from gleanery.operators.lookup import lookup_join
from gleanery.session import written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


# --- the plan over lengths with counts --------------------------------------------


class _Lengths:
    """A multiset of lengths: counts by length, and the lengths present in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.present = sorted(self.count)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for w in lengths:
            self.count[w] -= times
        for w in set(lengths):
            if not self.count[w]:
                del self.count[w]
                del self.present[bisect_left(self.present, w)]

    def left(self, w: int, used: tuple[int, ...]) -> int:
        return self.count.get(w, 0) - used.count(w)

    def largest(self, room: int, used: tuple[int, ...]) -> int | None:
        """The longest length of at most `room` beside those used."""
        at = bisect_right(self.present, room) - 1
        while at >= 0 and not self.left(self.present[at], used):
            at -= 1
        return self.present[at] if at >= 0 else None

    def least(self, n: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The n shortest pieces longer than `above` beside those used (fewer, if there are fewer)."""
        found: list[int] = []
        at = bisect_right(self.present, above)
        while len(found) < n and at < len(self.present):
            w = self.present[at]
            found += [w] * min(n - len(found), max(self.left(w, used), 0))
            at += 1
        return found

    def best_pair(self, room: int, j: int) -> tuple[int, int]:
        """Two pieces beside j whose sum is the largest of at most `room`; one pair fits."""
        best = (0, 0)
        low, high = 0, bisect_right(self.present, room) - 1
        while low <= high:
            a, b = self.present[high], self.present[low]
            if a + b > room or not self.left(a, (j,)):
                high -= 1
                continue
            if a + b > sum(best) and self.left(b, (j, a)) > 0:
                best = (a, b)
            low += 1
        return best


def dominating(lengths: _Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set with a piece of length j that dominates all others, or None.

    With room for no other piece it is j alone; with room for one, j and the longest that
    fits. A piece that fills the room exactly replaces any set. With room for two, the
    longest single piece dominates if no pair is longer than it; else that piece with the
    best second, if no two pieces fit that are both longer than the second.
    """
    room = capacity - j
    shortest = lengths.least(3, (j,))
    if not shortest or shortest[0] > room:
        return (j,)
    other = lengths.largest(room, (j,))
    if other == room or len(shortest) == 1 or shortest[0] + shortest[1] > room:
        return (j, other)
    if len(shortest) == 3 and sum(shortest) <= room:
        return None
    a, b = lengths.best_pair(room, j)
    if other >= a + b:
        return (j, other)
    between = lengths.least(2, (j, a, b), above=b)
    if other == a and (len(between) < 2 or sum(between) > room):
        return (j, a, b)
    return None


def reduce(lengths: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of `lengths` until there is none: (lengths, times).

    A set stays dominating while its lengths last, since what else is there only gets less,
    so it is taken as often as they do.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        at = len(lengths.present) - 1
        while at >= 0:
            j = lengths.present[at]
            found = dominating(lengths, j, capacity)
            if found is None:
                at -= 1
                continue
            times = min(lengths.count[w] // found.count(w) for w in found)
            lengths.take(found, times)
            fixed.append((found, times))
            changed = True
            at = min(bisect_right(lengths.present, j), len(lengths.present)) - 1
    return fixed


def best_fit(lengths: _Lengths, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit of falling lengths: (contents as (length, copies), number of sequences).

    A piece goes where it leaves the least room, so a sequence that takes one takes as many
    of the same length as it can before the next one does.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(room: int, contents: list[tuple[int, int]], times: int) -> None:
        if times:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((contents, times))

    for w in reversed(lengths.present):
        n = lengths.count[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                contents, times = [], -(-n // each)
                room = capacity
            else:
                room = rooms[at]
                contents, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // w
            full = min(times, n // each)
            put(room - each * w, contents + [(w, each)], full)
            n -= full * each
            if n and full < times:
                put(room - n * w, contents + [(w, n)], 1)
                put(room, contents, times - full - 1)
                n = 0
            else:
                put(room, contents, times - full)
    return [group for room in rooms for group in groups[room]]


SLOT = ("length", "first", "sequence", "copies", "offset")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots by (length, first): the pieces of a length from number `first` on go, `copies`
    to each, into the sequences from `sequence` on, the first of them at `offset`."""
    lengths = _Lengths(counts)
    made = [([(w, 1) for w in found], times) for found, times in reduce(lengths, capacity)]
    made += best_fit(lengths, capacity)
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for contents, times in made:
        offset = 0
        for w, copies in contents:
            rows.append((w, taken[w], sequence, copies, offset))
            taken[w] += copies * times
            offset += copies * w
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(len(rows), len(SLOT))


# --- pieces and their places ------------------------------------------------------


def _piece_writer(path: str, capacity: int):
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    kind = pa.schema(list(zip(names, kinds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for rows in batches:
            keys = rows.column("doc_id").to_pylist()
            done, size = [], 0
            for at, ids in encoded_runs(rows.column("text"), path):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    nth = seen.get(len(own), 0)
                    seen[len(own)] = nth + 1
                    done.append((keys[at], piece, start, len(own), own.tobytes(), part, nth))
                    size += own.nbytes
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema=kind)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema=kind)

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of each document, written to the shared folder.

    The ids of a document (null or empty: none) and the end id are cut only if they are
    more than `capacity`. Columns: doc_id, piece, start, length, ids (little-endian 32 bits),
    and the piece's place: `part` of the table, and `nth` of its length in that part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_piece_writer(vocabulary, capacity), PIECE), "pieces")


def _placer(slots: np.ndarray):
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])
    # Numbers of pieces of a length are below 2^44, lengths below 2^19.
    order = (slots[:, 0] << 44) + slots[:, 1]

    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, number in batches:
            length, number = length.to_numpy(), number.to_numpy()
            slot = slots[np.searchsorted(order, (length << 44) + number, "right") - 1]
            turn = number - slot[:, 1]
            sequence = slot[:, 2] + turn // slot[:, 3]
            offset = slot[:, 4] + turn % slot[:, 3] * length
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], fields=list(kind))

    return F.arrow_udf(place, "sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with length, part and nth.

    `pieces` reads a written table: `nth` counts the pieces of a length inside a part from
    0 on without gaps. Every piece gets a place of its own; sequences are filled from
    offset 0 without gaps. Only the counts of lengths, at most `capacity`, reach the driver.
    An empty table stays empty.
    """
    cell = (F.col("part").cast("long") * (capacity + 1) + F.col("length")).alias("_cell")
    counts = written(pieces.groupBy("part", "length", cell).agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    bases = written(counts.select("_cell", before), "bases")
    numbered = lookup_join(pieces.withColumn("_cell", cell), bases, "_cell")
    place = _placer(plan(total, capacity))("length", F.col("_before") + F.col("nth"))
    placed = numbered.withColumn("_place", place)
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the documents in them in order.

    A sequence holds at most `capacity` ids, so a group is as small.
    """
    placed = pack(token_pieces(docs, vocabulary, capacity), capacity)
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(held.alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    kept = F.transform("held", lambda p: p.dropFields("ids"))
    return whole.select("sequence_id", joined.alias("ids"), kept.alias("pieces"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the ids stay in their table, only their checksum is read."""
    import public_tokenizers

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    slim = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(slim).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
