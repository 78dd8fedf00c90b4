"""Merkle manifest of a dataset: a tree of SHA-256 states per group, then over the groups.

Every ARITY consecutive nodes of a level become their hash, until one is left. A node is
the hex text of its digest, one block of SHA-256, so the state of a parent's hash before
each of its children is eight words. Parents retain a copy of these states. To fold a
replaced leaf, the matching state is resumed with the replacement and the siblings right
of it; what is left of it is never hashed again.

A manifest is a folder of tables:

* ``leaves``: the rows with their place, ``grp``, ``pos`` and ``n`` (leaves of the group).
* ``segments``: aligned runs of ARITY^LEVELS leaves of a group: digests of all nodes below
  the segment's root, the states of all parents, and ``above``, the records (children,
  slot, state, siblings) that lead from the root of the segment to that of the dataset.

Roots of segments are the leaves of the next pass, so a pass has a two-thousandth of the
rows of the one before, and the roots of groups, in their order, are the leaves of one
more tree. Segments are dealt to tasks by a digest of their place; so a group of any size
is spread, and many small groups share a task. No list of nodes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import table
from gleanery.llm.midstates import bytes_state, compress, ended, hex_block, hex_text, started, state_bytes
from gleanery.operators.lookup import lookup_join
from gleanery.session import scratch_dir, written

ARITY = 3
LEVELS = 7
SEGMENT = ARITY**LEVELS

# One step from a node to its parent. A node has `m - 1` siblings, left to right.
RECORD = np.dtype([("m", "u1"), ("slot", "u1"), ("state", "u1", 32), ("siblings", "u1", (ARITY - 1, 32))])


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: each field is `-` if null, else its length in bytes, `:` and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


# --- places of leaves -------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number sorted rows inside (group, part)."""
    part, held, carried = TaskContext.get().partitionId(), None, 0
    for rows in batches:
        n = rows.num_rows
        if not n:
            continue
        grp = rows.column("grp")
        new = np.ones(n, bool)
        new[0] = grp[0].as_py() != held
        new[1:] = pc.not_equal(grp.slice(1), grp.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, -carried if not new[0] else 0))
        nth = at - first
        held, carried = grp[n - 1].as_py(), int(nth[-1]) + 1
        columns = [*rows.columns, pa.array(np.full(n, part, np.int32)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "part", "nth"])


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with `grp` (not null) get `pos`, their place in the group by `order`, and `n`.

    Rows are sorted into ranges of (group, order), numbered in their range and written; the
    counts of the earlier ranges are added. A range is cut inside a group where it is large.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_rows = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    numbered = written(sorted_rows.mapInArrow(_number, f"{kinds}, part int, nth long"), name)
    counts = written(numbered.groupBy("grp", "part").agg(F.count("*").alias("rows")), f"{name}-counts")
    group = Window.partitionBy("grp")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    bases = written(counts.select("grp", "part", before, F.sum("rows").over(group).alias("n")), f"{name}-bases")
    found = lookup_join(numbered, bases, ["grp", "part"])
    return found.select(*rows.columns, (F.col("before") + F.col("nth")).alias("pos"), "n")


# --- trees of one segment, many segments at once ----------------------------------


def heights(n: np.ndarray) -> np.ndarray:
    """Levels above the leaves of trees with so many leaves."""
    return sum((n > ARITY**k).astype(np.int64) for k in range(40))


def _grown(digests: np.ndarray, counts: np.ndarray, height: np.ndarray) -> tuple[list, list, list]:
    """Per level: digests of all nodes, states of all parents (ARITY - 1 each), and counts
    per segment. Segments whose height is reached have no nodes on the levels above."""
    levels, states, sizes = [digests], [], [counts]
    for level in range(int(height.max(initial=0))):
        going = height > level
        keep = np.repeat(going, counts)
        nodes, counts = digests[keep], np.where(going, counts, 0)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        slot = (np.arange(len(nodes)) - first) % ARITY
        parent = np.cumsum(slot == 0) - 1
        parents = int(parent[-1]) + 1 if len(parent) else 0
        m = np.bincount(parent, minlength=parents)
        child = np.zeros((parents, ARITY), np.int64)
        child[parent, slot] = np.arange(len(nodes))
        words = hex_block(nodes)
        state = started(parents)
        kept = np.zeros((parents, ARITY - 1, 32), np.uint8)
        for k in range(ARITY):
            if k:
                kept[:, k - 1] = state_bytes(state)
            own = np.flatnonzero(m > k)
            state[:, own] = compress(state[:, own], words[:, child[own, k]])
        digests, counts = ended(state, m), -(-counts // ARITY)
        levels.append(digests)
        states.append(kept)
        sizes.append(counts)
    return levels, states, sizes


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


GROWN = "grp string, block long, count int, height int, root binary, digests binary, states binary"


def _grow(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("grp", "ascending"), ("pos", "ascending")])
    grp = rows.column("grp").combine_chunks().dictionary_encode()
    block = rows.column("pos").to_numpy() // SEGMENT
    code = grp.indices.to_numpy().astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(block) != 0)]))
    counts = np.diff(np.append(first, len(block)))
    height = np.minimum(heights(rows.column("n").to_numpy()[first]), LEVELS)
    levels, states, sizes = _grown(_matrix(rows.column("leaf")), counts, height)
    ends = [np.cumsum(s) for s in sizes]
    names = grp.dictionary.to_pylist()
    found = []
    for k in range(len(first)):
        h = int(height[k])
        spans = [slice(int(ends[g][k] - sizes[g][k]), int(ends[g][k])) for g in range(h + 1)]
        found.append(
            {
                "grp": names[code[first[k]]],
                "block": int(block[first[k]]),
                "count": int(counts[k]),
                "height": h,
                "root": levels[h][spans[h]].tobytes(),
                "digests": b"".join(levels[g][spans[g]].tobytes() for g in range(h + 1)),
                "states": b"".join(states[g][spans[g + 1]].tobytes() for g in range(h)),
            }
        )
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in GROWN.split(", ")]
    return pa.Table.from_pylist(found, pa.schema(list(zip(names, kinds))))


class _Segments:
    """Some segments with their digests and states, found by (group, block)."""

    def __init__(self, rows: list[dict]):
        self.count = np.array([r["count"] for r in rows], np.int64)
        self.height = np.array([r["height"] for r in rows], np.int64)
        self.of = {(r["grp"], r["block"]): k for k, r in enumerate(rows)}
        self.digests = np.frombuffer(b"".join(r["digests"] for r in rows), np.uint8).reshape(-1, 32)
        self.states = np.frombuffer(b"".join(r["states"] for r in rows), np.uint8).reshape(-1, ARITY - 1, 32)
        top = int(self.height.max(initial=0))
        sizes = [self.count]
        for _ in range(top):
            sizes.append(-(-sizes[-1] // ARITY))
        self.sizes = np.stack(sizes, axis=1)
        exists = np.arange(top + 1)[None, :] <= self.height[:, None]
        nodes = self.sizes * exists
        parents = nodes.copy()
        parents[:, 0] = 0
        self.first_node = self._first(nodes)
        self.first_parent = self._first(parents)

    @staticmethod
    def _first(sizes: np.ndarray) -> np.ndarray:
        each = sizes.sum(axis=1)
        base = np.cumsum(each) - each
        return base[:, None] + np.cumsum(sizes, axis=1) - sizes

    def records(self, segment: np.ndarray, pos: np.ndarray, level: int) -> np.ndarray:
        """The step of each node from `level` to its parent."""
        at = pos // ARITY**level
        slot, parent = at % ARITY, at // ARITY
        found = np.zeros(len(at), RECORD)
        found["m"] = np.minimum(ARITY, self.sizes[segment, level] - parent * ARITY)
        found["slot"] = slot
        resumed = slot > 0
        places = self.first_parent[segment, level + 1] + parent
        found["state"][resumed] = self.states[places[resumed], slot[resumed] - 1]
        for k in range(ARITY - 1):
            other = k + (k >= slot)
            there = other < found["m"]
            nodes = self.first_node[segment, level] + parent * ARITY + other
            found["siblings"][there, k] = self.digests[nodes[there]]
        return found


def resume(current: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Digests of the parents of changed nodes: the state before the node, the node, and
    its right siblings."""
    state = bytes_state(steps["state"])
    state[:, steps["slot"] == 0] = started(1)
    state = compress(state, hex_block(current))
    for k in range(ARITY - 1):
        right = np.flatnonzero((k >= steps["slot"]) & (k + 1 < steps["m"]))
        if len(right):
            state[:, right] = compress(state[:, right], hex_block(steps["siblings"][right, k]))
    return ended(state, steps["m"].astype(np.uint32))


ABOVE = "grp string, pos long, above binary"


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records above each leaf of each segment: those inside, then those of the segment."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("above", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            own = _Segments([row])
            pos = np.arange(row["count"])
            none = np.zeros(len(pos), np.int64)
            steps = [own.records(none, pos, level) for level in range(row["height"])]
            inside = np.stack(steps, axis=1) if steps else np.zeros((len(pos), 0), RECORD)
            above = [r.tobytes() + row["above"] for r in inside]
            places = pa.array(pos + row["block"] * SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(pos)), places, pa.array(above)], schema=schema)


def _cells(block: Column, count: int) -> Column:
    """Segments are dealt by a digest of their place, as many to a cell as fill one."""
    return F.pmod(F.xxhash64("grp", block), F.lit(count)).alias("cell")


def _segments(nodes: DataFrame, name: str) -> DataFrame:
    cells = nodes.count() // SEGMENT + 1
    dealt = nodes.select("grp", "pos", "n", "leaf", _cells(F.floor(F.col("pos") / SEGMENT), cells))
    return written(dealt.groupBy("cell").applyInArrow(_grow, GROWN), name)


def _passes(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Segments of every pass, and the root of each group as (grp, leaf)."""
    found = [_segments(nodes, f"{name}-0")]
    while True:
        last = found[-1]
        roots = last.select("grp", F.col("block").alias("pos"), F.col("root").alias("leaf"))
        n = last.groupBy("grp").agg(F.count("*").alias("n"))
        if n.where("n > 1").isEmpty():
            return found, roots.select("grp", "leaf")
        found.append(_segments(roots.join(n, "grp"), f"{name}-{len(found)}"))


class Manifest:
    """The tables of a manifest: `leaves` (the rows, grp, pos, n) and `segments` (with
    subroot, root and above)."""

    def __init__(self, leaves: DataFrame, segments: DataFrame):
        self.leaves, self.segments = leaves, segments

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        return Manifest(spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/segments"))

    def fold(self, rows: DataFrame, replacement: str = "leaf") -> DataFrame:
        """Fold `rows` (leaves, or some of them) up to the root, each with its replacement.

        Adds subroot, root and folded_root (hex) and siblings, the proof: hex digests of all
        siblings, level by level from the leaf to the root, left to right. A null
        replacement stands for the leaf itself. Only the segments of the given rows are
        read, and a task holds about as many leaves as a segment has.
        """
        block = F.floor(F.col("pos") / SEGMENT).alias("block")
        segments = self.segments.join(rows.select("grp", block).distinct(), ["grp", "block"], "left_semi")
        cells = (segments.agg(F.sum("count")).first()[0] or 0) // SEGMENT + 1
        kept = [f for f in rows.schema.fields]
        given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        schema = f"{given}, subroot string, root string, folded_root string, siblings array<string>"
        changed = rows.withColumn("_changed", F.coalesce(replacement, "leaf")).withColumn("cell", _cells(block, cells))
        segments = segments.withColumn("cell", _cells(F.col("block"), cells))
        return changed.groupBy("cell").cogroup(segments.groupBy("cell")).applyInArrow(_folder([f.name for f in kept]), schema)


def _hex_list(digests: np.ndarray) -> pa.Array:
    text = hex_text(digests)
    offsets = pa.py_buffer(np.arange(0, 64 * len(text) + 1, 64, dtype=np.int32))
    return pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer(text.tobytes()))


def _folder(names: list[str]):
    def fold(rows: pa.Table, segments: pa.Table) -> pa.Table:
        listed = segments.to_pylist()
        wanted = {*zip(rows.column("grp").to_pylist(), (rows.column("pos").to_numpy() // SEGMENT).tolist())}
        listed = [r for r in listed if (r["grp"], r["block"]) in wanted]
        own = _Segments(listed)
        pos = rows.column("pos").to_numpy()
        places = zip(rows.column("grp").to_pylist(), (pos // SEGMENT).tolist())
        segment = np.array([own.of[p] for p in places], np.int64)
        pos = pos % SEGMENT
        current = _matrix(rows.column("_changed")).copy()
        above = [np.frombuffer(r["above"], RECORD) for r in listed]
        longest = np.array([len(a) for a in above], np.int64)
        inside = own.height[segment]
        total = inside + longest[segment]
        siblings = np.zeros((len(pos), int(total.max(initial=0)), ARITY - 1, 32), np.uint8)
        present = np.zeros(siblings.shape[:3], bool)
        for level in range(siblings.shape[1]):
            for here in (np.flatnonzero(inside > level), np.flatnonzero((inside <= level) & (total > level))):
                if not len(here):
                    continue
                at = segment[here]
                if inside[here[0]] > level:
                    steps = own.records(at, pos[here], level)
                else:
                    steps = np.array([above[s][level - own.height[s]] for s in at.tolist()], RECORD)
                siblings[here, level] = steps["siblings"]
                present[here, level] = np.arange(1, ARITY)[None, :] < steps["m"][:, None]
                current[here] = resume(current[here], steps)
        offsets = np.concatenate([[0], np.cumsum(present.sum(axis=(1, 2)))]).astype(np.int32)
        for name in ("subroot", "root"):
            digests = _matrix(pa.array([r[name] for r in listed], pa.binary()))[segment]
            rows = rows.append_column(name, _hex_list(digests))
        rows = rows.append_column("folded_root", _hex_list(current))
        rows = rows.append_column("siblings", pa.ListArray.from_arrays(pa.array(offsets), _hex_list(siblings[present])))
        return rows.select([*names, "subroot", "root", "folded_root", "siblings"])

    def run(rows: pa.Table, segments: pa.Table) -> pa.Table:
        if rows.num_rows:
            return fold(rows, segments)
        kinds = [(n, rows.schema.field(n).type) for n in names]
        added = [(n, pa.string()) for n in ("subroot", "root", "folded_root")]
        return pa.schema([*kinds, *added, ("siblings", pa.list_(pa.string()))]).empty_table()

    return run


def build_manifest(rows: DataFrame, group: Column, order: list[str], path: str) -> Manifest:
    """Write the manifest of `rows`, which have `leaf` (32 bytes, not null).

    Groups are ordered by the bytes of their name, null first; leaves of a group by
    `order` (nulls first), then by the leaf, so repeated rows stand together and the
    tree does not depend on how the rows were dealt. The names grp, pos and n are the
    manifest's own. An empty table has an empty manifest.
    """
    spark = rows.sparkSession
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")))
    # Tells apart repeated rows, so that a large number of them is cut into ranges too.
    named = written(named.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    leaves = placed(named, [*order, "leaf", "_row"], "places").drop("_row")
    leaves.write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")

    passes, subroots = _passes(leaves, "segments")
    named_roots = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "leaf")
    groups = written(placed(named_roots, ["name"], "groups"), "group-leaves")
    group_passes, root = _passes(groups, "group-segments")

    above = root.select("grp", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("above"))
    for segments in reversed(group_passes):
        at = segments.withColumnRenamed("block", "pos").join(above, ["grp", "pos"]).withColumnRenamed("pos", "block")
        above = written(at.mapInArrow(_lead, ABOVE), "above")
    ends = groups.withColumnRenamed("grp", "_all").join(above, "pos").select(
        F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "above"
    )
    top = root.first()  # one digest, or none of an empty table
    ends = written(ends.withColumn("root", F.lit(bytes(top["leaf"]) if top else b"")), "ends")
    above = ends.select("grp", F.lit(0).cast("long").alias("pos"), "above")
    for segments in reversed(passes[1:]):
        at = segments.withColumnRenamed("block", "pos").join(above, ["grp", "pos"]).withColumnRenamed("pos", "block")
        above = written(at.mapInArrow(_lead, ABOVE), "above")
    led = passes[0].drop("root").join(above.withColumnRenamed("pos", "block"), ["grp", "block"])
    lookup_join(led, ends.drop("above"), "grp").write.parquet(f"{path}/segments")
    return Manifest.read(spark, path)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Rows whose id has an even CRC-32 are folded with the leaf of their text
    without line breaks; a null id has no CRC-32 and is not tampered with."""
    docs = table(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.col("text")
    fields = [key, F.col("source"), F.col("lang"), F.col("n_chars")]
    odd = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    tampered = F.when(odd, leaf_of(*fields, F.replace(text, F.lit("\n"), F.lit(""))))
    rows = docs.select(
        key.cast("long").alias("doc_id"), F.col("source").alias("source"),
        leaf_of(*fields, text).alias("leaf"), tampered.alias("tampered"),
    )
    manifest = build_manifest(rows, F.col("source"), ["doc_id"], scratch_dir(spark, "manifest"))
    folded = manifest.fold(manifest.leaves, "tampered")
    return folded.select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# The lowest bit of CRC-32 comes from its definition, byte by byte and bit by bit.
OP12_SQL = """
with recursive
rows as (
    select *, doc_id::varchar as k,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
        replace(text, chr(10), '') as flat
    from documents),
leaves as (
    select doc_id, source,
        sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when k is not null and list_reduce(
            list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
            lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
                lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 1 = 1
        then sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) end as tampered
    from rows),
placed as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
        count(*) over (partition by source) as n
    from leaves),
low as (
    select 0 as level, source, pos, leaf as digest, n from placed
    union all
    select level + 1, source, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 2) // 3
    from low where n > 1 group by level, source, pos // 3),
subroots as (
    select source, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n, level
    from low where n = 1),
high as (
    select 0 as level, pos, digest, n from subroots
    union all
    select level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 2) // 3
    from high where n > 1 group by level, pos // 3),
low_steps as (
    select l.source, l.level, l.pos, string_agg(s.digest, '' order by s.pos) filter (s.pos < l.pos) as before,
        string_agg(s.digest, '' order by s.pos) filter (s.pos > l.pos) as after
    from low l join low s on l.source is not distinct from s.source and l.level = s.level and l.pos // 3 = s.pos // 3
    where l.n > 1 group by l.source, l.level, l.pos),
high_steps as (
    select l.level, l.pos, string_agg(s.digest, '' order by s.pos) filter (s.pos < l.pos) as before,
        string_agg(s.digest, '' order by s.pos) filter (s.pos > l.pos) as after
    from high l join high s on l.level = s.level and l.pos // 3 = s.pos // 3
    where l.n > 1 group by l.level, l.pos),
climb as (
    select doc_id, source, pos as leaf_pos, leaf, 0 as level, pos, coalesce(tampered, leaf) as digest, '' as proof
    from placed
    union all
    select c.doc_id, c.source, c.leaf_pos, c.leaf, c.level + 1, c.pos // 3,
        sha256(coalesce(s.before, '') || c.digest || coalesce(s.after, '')),
        c.proof || coalesce(s.before, '') || coalesce(s.after, '')
    from climb c join low_steps s
        on c.source is not distinct from s.source and c.level = s.level and c.pos = s.pos),
summit as (
    select c.doc_id, c.leaf, r.digest as subroot, 0 as level, r.pos, c.digest, c.proof, c.source, c.leaf_pos
    from climb c join subroots r on c.source is not distinct from r.source and c.level = r.level
    union all
    select c.doc_id, c.leaf, c.subroot, c.level + 1, c.pos // 3,
        sha256(coalesce(s.before, '') || c.digest || coalesce(s.after, '')),
        c.proof || coalesce(s.before, '') || coalesce(s.after, ''), c.source, c.leaf_pos
    from summit c join high_steps s on c.level = s.level and c.pos = s.pos),
root as (select level, digest from high where n = 1)
select c.doc_id, c.leaf, c.subroot, r.digest as root, sha256(c.proof) as proof_sha256, c.digest as folded_root,
    c.digest = r.digest as verified
from summit c join root r on c.level = r.level
"""
