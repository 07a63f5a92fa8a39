"""N-gram Jaccard self-join of documents with signature trees.

Two documents link when 100 * intersection >= 75 * union of their sets of
distinct five-word shingles; the result names each document's connected
component.  Documents with equal sets are one class; only classes are compared.

1.  Blocks.  Put in one global order, the first n // 4 + 1 shingles of a set of n
    hold the first shingle that it shares with any set linked to it: a linked set
    lacks at most n // 4 of them.  So classes that link share a shingle of these
    prefixes, without exception, and only classes of such a block meet.  The
    order is that of the hashes, but shingles of more than HOT prefixes come
    last (a passage that many documents share), as a bitmap of fixed size says;
    any order is complete, this one keeps blocks small.  Of blocks with the same
    classes one is kept.
2.  Stars.  In each block every class is tied to the block's least class; each
    class verifies, on the whole sets, the tie that most of its blocks propose.
    Verified ties give first components, so a large family of near copies is
    nearly one component after a check a member.  Ties decide no "no".
3.  Trees.  In blocks that still hold several components, the classes outside the
    largest one meet all others in signature trees: the dual traversal drops
    node pairs whose components are one or whose largest possible overlap is too
    small.  What is left is written as (class, component) where the other side is
    the largest or another large component, else as single pairs while a pair of
    leaves has few, else as the pair of leaves with its classes.  A first turn
    takes each class in its largest such block alone, which joins most of a
    family that meets in many blocks; the second takes every block that is left.
4.  Verification.  A class meets the whole sets of the component, in chunks of
    about CHUNK shingles and again by trees, and one exact link is enough; in a
    pair of leaves every pair of whole sets is checked exactly, but for those
    that links found there have joined already.

No block or component is gathered as a whole: blocks are dealt out in parts of at
most BLOCK classes and PART_TOKENS shingles, components in chunks, leaf pairs hold
at most 96 sets.

Defined results: null and empty texts have the empty set, link with nothing and
are their own component; a null doc_id counts for no component's name, and a
component of such rows alone has none; rows that repeat an id give a row each,
with their own text's component; an empty table gives an empty result; further
columns, whatever their names, are ignored here and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .bitmaps import BITS, ROW_BITS, assembled, bitmap_of, hits, marked, unpacked
from .components import connected_components
from .signature_tree import LEAF, LEAF_TOKENS, Tree, bitmap, bits_for, dual_join, join_leaves, join_sets, near
from .storage import materialise, materialise_parts, release, table, tidy
from .words import bytes_column, list_column, row_slices, shingle_sets

#: Prefixes that a shingle may be in before it is put last, and turns of that.
HOT, DEMOTIONS = 1000, 2
#: Classes of a block, and their shingles, that one task compares with as many.
BLOCK, PART_TOKENS = 2000, 4_000_000
#: Shingles of a component that one task holds, about.
CHUNK = 400_000
#: Turns, a power of two, that rows and search jobs are worked on in, and rows of a turn
#: while that takes fewer turns.
TURNS, TURN_ROWS, JOB_ROWS = 4, 60_000, 400_000
#: Classes of a component that is searched as a whole, and pairs of a pair of leaves that are written one by one.
LARGE, SINGLE_PAIRS = 8, 64
_CLASSED = "id bigint, th binary, digest binary, n int, prefix binary, map binary"
#: Keys that a task counts before it sends them on.
TALLY = 1 << 21


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def prefix(s: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set in the global order."""
    if hot is not None:
        late = hits(hot, s)
        if late.any():
            s = np.concatenate((s[~late], s[late]))
    return s[: len(s) // 4 + 1]


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in row_slices(whole)):
        sets = shingle_sets(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                bytes_column([prefix(s) for s in sets]), bytes_column([bitmap(s, bits_for(len(s))) for s in sets]),
            ],
            names=["id", "th", "digest", "n", "prefix", "map"],
        )


def _flat(column: pa.Array, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of packed numbers, and each row's ends in them."""
    size = np.dtype(kind).itemsize
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)
    return held, (ends - ends[0]) // size


def _ragged(column: pa.Array) -> list[np.ndarray]:
    flat, ends = _flat(column)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A sorted stream in parts that hold whole runs of equal keys, with their starts and the end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first, end = (tuple(c[i] for c in columns) for i in (0, -1))
        if held and first == last == end:
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch]) if held else batch
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
        if len(starts) > 1:
            yield whole.slice(0, starts[-1]), starts
        held, last = [whole.slice(starts[-1])], end
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.array([0, whole.num_rows])


class _Classes:
    """The classes of a table, and whole sets of those that are asked for."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark = rows, rows.sparkSession
        self.scratch: list[DataFrame] = []  # tables that the next links are made of
        turn = F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(TURNS - 1))
        made = rows.select("id", "th", "text").mapInArrow(_classed, _CLASSED).withColumn("turn", turn)
        slim, tables = [], []
        for k, heavy in enumerate(materialise_parts(made, "sets", "turn", TURN_ROWS)):
            slim.append(materialise(heavy.select("id", "th", "digest", "n"), "rows"))
            classes = heavy.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "map")])
            tables.append(materialise(classes.withColumn("cid", F.monotonically_increasing_id() * TURNS + k), "classes"))
            release(heavy)
            tidy(self.spark)
        self.slim, self.classes = reduce(DataFrame.unionAll, slim), reduce(DataFrame.unionAll, tables)
        self.names = self.classes.select("cid", "digest", "least")
        self.sets: DataFrame | None = None
        same = self.slim.filter("n > 0").groupBy("id", "digest").count().filter("count > 1")
        self.repeated = not same.isEmpty()

    def without_prefixes(self) -> None:
        """Keep of the classes what is needed once blocks are known."""
        whole, self.classes = self.classes, materialise(self.classes.drop("prefix"), "classes")
        self.names = self.classes.select("cid", "digest", "least")
        release(whole)

    def clear(self) -> None:
        """Delete what the links that are known now were made of, and let Spark drop
        the shuffle files of steps that are over."""
        for t in self.scratch:
            release(t)
        self.scratch = []
        tidy(self.spark)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """``cid, shingles`` of at least the wanted classes (``cid``)."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        found = self.hashed(wanted)
        self.sets = found if self.sets is None else self.sets.unionAll(found)
        return self.sets

    def chosen(self, wanted: DataFrame) -> DataFrame:
        return materialise(self.names.join(wanted, "cid", "left_semi"), "wanted")

    def hashed_rows(self, chosen: DataFrame, hot: Broadcast | None = None) -> tuple[DataFrame, Broadcast]:
        """``i, d, shingles`` of rows that hold the chosen classes, hashed again where
        their texts lie (of each set the prefix alone, if ``hot`` ones come last); and what is to be destroyed when they are written."""
        shared = self.spark.sparkContext.broadcast(bitmap_of(chosen.select(F.xxhash64("least").alias("key"))))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, late = unpacked(shared.value), None if hot is None else unpacked(hot.value)
            for batch in batches:
                at = np.flatnonzero(hits(bits, batch.column(1).to_numpy().view(np.uint64)))
                for part in (at[a : a + 512] for a in range(0, len(at), 512)):
                    some = batch.take(pa.array(part))
                    sets = shingle_sets(some.column(2))
                    digests = pa.array([_digest(s) for s in sets], pa.binary())
                    sets = sets if late is None else [prefix(s, late) for s in sets]
                    yield pa.RecordBatch.from_arrays([some.column(0), digests, bytes_column(sets)], names=["i", "d", "shingles"])

        return self.rows.select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(build, "i bigint, d binary, shingles binary"), shared

    def placed(self, rows: DataFrame, chosen: DataFrame, value: str) -> DataFrame:
        """``cid`` and ``value`` of rows (i, d, value), one of each chosen class."""
        found = rows.join(chosen, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("least"))).select("cid", value)
        return found.dropDuplicates(["cid"]) if self.repeated else found  # rows that repeat an id and a set

    def hashed(self, wanted: DataFrame) -> DataFrame:
        """``cid, shingles`` of the wanted classes."""
        chosen = self.chosen(wanted)
        rows, shared = self.hashed_rows(chosen)
        found = materialise(self.placed(rows, chosen, "shingles"), "shingles")
        shared.destroy()  # written: no task asks for it again
        release(chosen)
        return found

    def linkable(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that signatures allow to link."""
        known = self.classes.select("cid", "n", "map")
        met = pairs.select("a", "b").join(known.toDF("a", "na", "mapa"), "a").join(known.toDF("b", "nb", "mapb"), "b")
        return materialise(met.select("a", "b", "na", "nb", "mapa", "mapb").mapInArrow(_near_pairs, "a bigint, b bigint"), "pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = self.linkable(pairs)
        sets = self.sets_of(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.toDF("a", "mine"), "a").join(sets.toDF("b", "shingles"), "b")
        return both.select("a", "b", "mine", "shingles").mapInArrow(_linked_pairs, _LINKS)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        maps = zip(_ragged(batch.column(4)), _ragged(batch.column(5)), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([near(s, m) for s, m in zip(sizes, maps, strict=True)], pa.bool_()))


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(_ragged(batch.column(2)), _ragged(batch.column(3)), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([_linked(x, y) for x, y in both], pa.bool_()))


def _filtered_keys(prefixes: DataFrame, shared: Broadcast) -> DataFrame:
    """``cid, key`` of the prefixes' shingles that a bitmap has."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap_ = unpacked(shared.value)
        for batch in (part for whole in batches for part in row_slices(whole)):
            flat, ends = _flat(batch.column(1))
            keep = hits(bitmap_, flat)
            cid = np.repeat(batch.column(0).to_numpy(), np.diff(ends))[keep]
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(flat[keep].view(np.int64))], names=["cid", "key"])

    return prefixes.select("cid", "prefix").mapInArrow(keys, "cid bigint, key bigint")


def _with_any(prefixes: DataFrame, shared: Broadcast, wanted: bool) -> DataFrame:
    """The prefixes that have a shingle of a bitmap, or those that have none; told
    where they lie."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap_ = unpacked(shared.value)
        for batch in (part for whole in batches for part in row_slices(whole)):
            flat, ends = _flat(batch.column(1))
            found = np.concatenate(([0], np.cumsum(hits(bitmap_, flat))))
            yield batch.filter(pa.array((np.diff(found[ends]) > 0) == wanted))

    return prefixes.select("cid", "prefix").mapInArrow(told, "cid bigint, prefix binary")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``w, keys, counts``: what a task's prefixes hold, by rows of the bitmap.  Of a
    shingle 31 bits are enough; those that name the row and the bit go first."""
    held: list[np.ndarray] = []

    def sent() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        held.clear()
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts, keys = np.diff(np.concatenate((at, [len(keys)]))).astype(np.uint32), keys[at]
        cuts = np.searchsorted(keys, np.arange((1 << (BITS - ROW_BITS)) + 1, dtype=np.uint64) << np.uint64(ROW_BITS + 31 - BITS))
        w = np.flatnonzero(np.diff(cuts))
        ends = np.concatenate((cuts[w], cuts[-1:]))
        packed = [pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(x)]) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), *packed], names=["w", "keys", "counts"])

    for batch in (part for whole in batches for part in row_slices(whole)):
        key = _flat(batch.column(0))[0] & np.uint64(0x7FFFFFFF)
        held.append(((key & np.uint64((1 << BITS) - 1)) << np.uint64(31 - BITS) | key >> np.uint64(BITS)).astype(np.uint32))
        if sum(map(len, held)) >= TALLY:
            yield sent()
    if sum(map(len, held)):
        yield sent()


def _counted(prefixes: DataFrame) -> DataFrame:
    """``w, bits, hot``: a bitmap of the shingles that are in more than one prefix, by
    rows, and in each row those of more than HOT; low halves are enough for bitmaps."""
    most = HOT

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["w"]):
            keys, counts = (_flat(t.column(c), np.uint32)[0] for c in ("keys", "counts"))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts, keys = np.add.reduceat(counts[order].astype(np.int64), at), keys[at].astype(np.int64)
            bits = np.zeros(1 << ROW_BITS, bool)
            bits[(keys[counts > 1] >> (31 - BITS)) & ((1 << ROW_BITS) - 1)] = True
            hot = keys[counts > most]
            hot = (hot & ((1 << (31 - BITS)) - 1)) << BITS | hot >> (31 - BITS)
            yield pa.RecordBatch.from_arrays([t.column("w")[:1], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), list_column([hot], pa.int64())], names=["w", "bits", "hot"])

    sent = prefixes.select("prefix").mapInArrow(_tally, "w int, keys binary, counts binary")
    return materialise(sent.repartition("w").sortWithinPartitions("w").mapInArrow(summed, "w int, bits binary, hot array<bigint>"), "keys")


def _prefixes(found: _Classes) -> tuple[DataFrame, list[DataFrame]]:
    """``cid, prefix`` of every class in an order that puts hot shingles last, and
    tables to release: at the end those counted in several prefixes."""
    first = found.classes.select("cid", "prefix")
    shared = _counted(first)
    tidy(found.spark)
    hot = shared.select(F.explode("hot").alias("key"))
    if hot.isEmpty():
        return first, [shared]
    hot = materialise(hot, "hot")
    touched = chosen = None
    for turn in range(DEMOTIONS):
        # One order for all: the hot shingles as they are known now come last.  Only
        # classes whose first prefix has one of them have another prefix in it.
        shared_bits = found.spark.sparkContext.broadcast(bitmap_of(hot))
        now = materialise(_with_any(first, shared_bits, True).select("cid"), "touched")
        new = found.chosen(now if touched is None else now.join(touched, "cid", "left_anti"))
        touched, chosen = now, new if chosen is None else chosen.unionAll(new)
        # Hashed again in each turn: prefixes are written and shuffled, whole sets are not.
        made, shared_names = found.hashed_rows(chosen, shared_bits)
        moved = materialise(found.placed(made, chosen, "shingles").withColumnRenamed("shingles", "prefix"), "prefixes")
        shared_names.destroy()
        if turn == DEMOTIONS - 1:
            break
        counted = _counted(moved)
        more = materialise(counted.select(F.explode("hot").alias("key")).join(hot, "key", "left_anti"), "hot")
        release(counted)
        if more.isEmpty():
            break
        hot = hot.unionAll(more)
        release(moved)
        shared_bits.destroy()
    for t in (chosen, shared):
        release(t)

    # The rest are those without a hot shingle; nothing is shuffled.
    every = _with_any(first, shared_bits, False).unionAll(moved)
    tidy(found.spark)
    return every, [moved, _counted(every)]


def _blocks(found: _Classes) -> DataFrame:
    """``key, cid, leader, weight``: the classes of each block, its least class and
    how many blocks are alike."""
    prefixes, done = _prefixes(found)
    found.clear()
    shared_bits = found.spark.sparkContext.broadcast(assembled(done[-1]))
    rows = _filtered_keys(prefixes, shared_bits)
    signature = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    blocks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("cid").alias("leader"), *signature).filter("held > 1")
    alike = materialise(blocks.groupBy("held", "leader", "x0", "x1").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "leader", "weight"), "alike")
    out = materialise(rows.join(alike, "key").select("key", "cid", "leader", "weight"), "blocks")
    shared_bits.destroy()
    for t in (alike, *done):
        release(t)
    return out


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``cid, comp`` after further links (a, b) between classes; the components
    are found on the graph of components."""
    edges = links.join(comps.toDF("a", "x"), "a").join(comps.toDF("b", "y"), "b")
    found = connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = comps.join(found, F.col("comp") == F.col("node"), "left").select("cid", F.coalesce("component", "comp").alias("comp"))
    return materialise(new, "components")


def _mixed(blocks: DataFrame, comps: DataFrame, found: _Classes) -> DataFrame:
    """``key, cid, comp, weight, head, held, tokens`` of the blocks that hold several
    components; head is a member (cid, comp) of the largest component in it."""
    weights = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    placed = blocks.select("key", "cid").join(comps.join(weights, "comp").join(found.classes.select("cid", "n"), "cid"), "cid")
    by = F.struct("weight", "comp", F.xxhash64("cid", "key"), "cid")
    heads = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("held"), F.sum("n").alias("tokens"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(by).alias("head")
    ).filter("low != high")
    heads = heads.select("key", "held", "tokens", F.struct(F.col("head.cid").alias("cid"), F.col("head.comp").alias("comp")).alias("head"))
    # Written first, so that the join below deals rows out anew and may split a hot key.
    heads = materialise(heads, "heads")
    return materialise(placed.select("key", "cid", "comp", "weight").join(heads, "key"), "mixed")


def _one_block_each(mixed: DataFrame) -> DataFrame:
    """``key, cid``: the largest of each class's blocks."""
    largest = mixed.groupBy("cid").agg(F.max(F.struct("held", "key")).alias("largest"))
    return materialise(largest.select("largest.key", "cid"), "largest")


_LEAVES = "xs array<bigint>, ys array<bigint>, comp bigint"


def _to_check(t: pa.RecordBatch, x: np.ndarray, y: np.ndarray, of: np.ndarray) -> list[tuple]:
    """The rows of :func:`_search` for pairs x, y of its rows (of: their pair of leaves)."""
    cid, comp, weight = (t.column(c).to_numpy() for c in ("cid", "comp", "weight"))
    main = t.column("main").to_numpy(zero_copy_only=False)
    once = main[y] | (cid[x] < cid[y])  # classes outside the largest component meet each other twice
    x, y, of = x[once], y[once], of[once]
    swap = ~main[y] & ((weight[x] > weight[y]) | ((weight[x] == weight[y]) & (comp[x] > comp[y])))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    large = main[y] | (weight[y] > LARGE)
    rows = [(np.unique(cid[x[large & (comp[y] == c)]]), cid[:0], c) for c in np.unique(comp[y[large]]).tolist()]
    x, y, of = cid[x[~large]], cid[y[~large]], of[~large]
    leaves, held = np.unique(of, return_counts=True)
    for k in leaves[held > SINGLE_PAIRS].tolist():
        rows.append((np.unique(x[of == k]), np.unique(y[of == k]), None))
    alone = np.isin(of, leaves[held <= SINGLE_PAIRS])
    return rows + [(np.array([i]), np.array([j]), None) for i, j in set(zip(x[alone].tolist(), y[alone].tolist(), strict=True))]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each job (a part of a block's classes outside the largest component
    against a part of all), what bitmaps allow: classes xs that may link with a
    large component, or classes xs and ys that may link with each other.  Jobs whose
    two sides fit a leaf each are trees of one node, and many are met at once."""
    for t, starts in _whole_groups(batches, ["key", "p", "q"]):
        side, comp, n = (t.column(c).to_numpy(zero_copy_only=False) for c in ("side", "comp", "n"))
        n, maps = n.astype(np.int64), _ragged(t.column("map"))
        jobs = len(starts) - 1
        job = np.repeat(np.arange(jobs), np.diff(starts))
        rows: list[tuple] = []
        held = [np.bincount(job[of], minlength=jobs) for of in (side, ~side)]
        tokens = [np.bincount(job[of], n[of], jobs) for of in (side, ~side)]
        small = np.logical_and.reduce([h <= LEAF for h in held] + [k <= LEAF_TOKENS for k in tokens])
        met = small[job]
        for x, y in join_leaves(n, maps, comp, np.flatnonzero(side & met), np.flatnonzero(~side & met), job):
            rows += _to_check(t, x, y, job[x])
        for k in np.flatnonzero(~small & (held[0] > 0) & (held[1] > 0)).tolist():
            a, b = starts[k], starts[k + 1]
            for x, y in join_sets(n, maps, comp, a + np.flatnonzero(side[a:b]), a + np.flatnonzero(~side[a:b])):
                rows += _to_check(t, x, y, np.zeros(len(x), np.int64))
                if len(rows) >= 4096:
                    yield _leaf_rows(rows)
                    rows = []
        if rows:
            yield _leaf_rows(rows)


def _leaf_rows(rows: list[tuple[np.ndarray, np.ndarray, int | None]]) -> pa.RecordBatch:
    xs, ys, comp = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([list_column(list(xs), pa.int64()), list_column(list(ys), pa.int64()), pa.array(comp, pa.int64())], names=["xs", "ys", "comp"])


def _searched(mixed: DataFrame, found: _Classes) -> DataFrame:
    """``xs, ys, comp`` as of :func:`_search`, of all blocks."""
    rows = mixed.withColumn("main", F.col("comp") == F.col("head.comp"))
    outside = rows.groupBy("key").agg(F.count(F.when(~F.col("main"), 1)).alias("out"))
    outside = materialise(outside, "outside")
    found.scratch.append(outside)
    rows = rows.join(outside, "key")

    def parts(of):
        return F.greatest(F.ceil(F.col(of) / BLOCK), F.ceil(F.col(of) / F.col("held") * F.col("tokens") / PART_TOKENS), F.lit(1)).cast("int")

    rows = rows.withColumn("ps", parts("out")).withColumn("qs", parts("held"))
    h = F.xxhash64("cid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = rows.filter("NOT main").withColumn("p", F.pmod(h, "ps").cast("int")).withColumn("q", every("qs")).withColumn("side", F.lit(True))
    theirs = rows.withColumn("q", F.pmod(h, "qs").cast("int")).withColumn("p", every("ps")).withColumn("side", F.lit(False))
    names = ["key", "p", "q", "cid", "comp", "weight", "main", "side"]
    jobs = mine.select(names).unionByName(theirs.select(names)).withColumn("turn", F.pmod(F.xxhash64("key", "p", "q"), F.lit(TURNS)).cast("int"))
    parts = []
    for part in materialise_parts(jobs, "turns", "turn", JOB_ROWS):  # signatures of a turn's jobs only are on disk
        met = part.join(found.classes.select("cid", "n", "map"), "cid")
        dealt = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").select(*names, "n", "map")
        parts.append(materialise(dealt.mapInArrow(_search, _LEAVES).distinct(), "parts"))
        release(part)
        tidy(found.spark)
    leaves = materialise(reduce(DataFrame.unionAll, parts).distinct().withColumn("pair", F.monotonically_increasing_id()), "leaves")
    for part in parts:
        release(part)
    found.clear()
    return leaves


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if 4 * len(a) < 3 * len(b) or 4 * len(b) < 3 * len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return 7 * int((b[at] == a).sum()) >= 3 * (len(a) + len(b))


_LINKS = "a bigint, b bigint"


def _verify_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each pair of leaves, as many as join what they join."""
    for t in _groups(batches, ["pair"]):
        cid, side, comp, sets = t.column("cid").to_numpy(), t.column("side").to_numpy(zero_copy_only=False), t.column("comp").to_numpy().copy(), _ragged(t.column("shingles"))
        links = []
        for i in np.flatnonzero(side).tolist():
            for j in np.flatnonzero(~side & (comp != comp[i])).tolist():
                if comp[j] != comp[i] and _linked(sets[i], sets[j]):
                    links.append((cid[i], cid[j]))
                    comp[comp == comp[j]] = comp[i]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of a component, one link for each class that has any."""
    for t in _groups(batches, ["comp", "chunk", "share"]):
        probe, cid, sets = t.column("probe").to_numpy(zero_copy_only=False), t.column("cid").to_numpy(), _ragged(t.column("shingles"))
        sizes = np.array([len(s) for s in sets], np.int64)
        members, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
        linked: dict[int, int] = {}
        for magnitude in np.unique([n.bit_length() for n in sizes[probes].tolist()]).tolist():
            mine = probes[[n.bit_length() == magnitude for n in sizes[probes].tolist()]]
            low, high = sizes[mine].min(), sizes[mine].max()
            close = members[(4 * sizes[members] >= 3 * low) & (3 * sizes[members] <= 4 * high)]
            if not len(close):
                continue
            bits = 4 * bits_for(int(high))  # whole sets are at hand: wide signatures
            left = Tree(sizes[mine], np.stack([bitmap(sets[i], bits) for i in mine]), np.zeros(len(mine), np.int64))
            right = Tree(sizes[close], np.stack([bitmap(sets[i], bits) for i in close]), np.ones(len(close), np.int64))
            for x, y in dual_join(left, right):
                for i, j in zip(mine[x].tolist(), close[y].tolist(), strict=True):
                    if i not in linked and _linked(sets[i], sets[j]):
                        linked[i] = j
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array(cid[list(linked)], pa.int64()), pa.array(cid[list(linked.values())], pa.int64())], names=["a", "b"])


def _tree_links(mixed: DataFrame, comps: DataFrame, found: _Classes) -> DataFrame:
    searched = _searched(mixed, found)
    leaves = searched.filter("comp IS NULL")
    leaves = leaves.select("pair", F.explode("xs").alias("cid"), F.lit(True).alias("side")).unionAll(leaves.select("pair", F.explode("ys"), F.lit(False)))
    leaves = materialise(leaves, "members")
    probes = searched.filter("comp IS NOT NULL").select("comp", F.explode("xs").alias("cid")).distinct()
    # Components in chunks; a chunk's probes are dealt out too, the members going to each share.
    members = comps.join(probes.select("comp").distinct(), "comp").join(found.classes.select("cid", "n"), "cid")
    chunks = materialise(members.groupBy("comp").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks")), "chunks")
    shares = probes.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
    chunks = materialise(chunks.join(shares, "comp"), "chunks")
    h, every = F.xxhash64("cid"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = members.select("comp", "cid").join(chunks, "comp").withColumn("chunk", F.pmod(h, "chunks").cast("int")).withColumn("share", every("shares")).withColumn("probe", F.lit(False))
    theirs = probes.join(chunks, "comp").withColumn("share", F.pmod(h, "shares").cast("int")).withColumn("chunk", every("chunks")).withColumn("probe", F.lit(True))
    jobs = materialise(mine.unionByName(theirs).select("comp", "chunk", "share", "cid", "probe"), "jobs")
    found.scratch += [searched, leaves, jobs, chunks]
    sets = found.sets_of(leaves.select("cid").union(jobs.select("cid")).distinct())
    met = leaves.join(comps, "cid").join(sets, "cid").select("pair", "cid", "side", "comp", "shingles")
    links = met.repartition("pair").sortWithinPartitions("pair").mapInArrow(_verify_leaves, _LINKS)
    met = jobs.join(sets, "cid").select("comp", "chunk", "share", "cid", "probe", "shingles")
    return links.unionAll(met.repartition("comp", "chunk", "share").sortWithinPartitions("comp", "chunk", "share").mapInArrow(_verify_chunks, _LINKS))


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` has id, th and text.  ``id, th, n, component`` of each row (a null
    component: the empty set), and each component's least id."""
    spark = rows.sparkSession
    tidy(spark)
    found = _Classes(rows)
    found.clear()
    blocks = _blocks(found)
    found.without_prefixes()
    found.clear()
    comps = materialise(blocks.select("cid").distinct().select("cid", F.col("cid").alias("comp")), "components")
    ties = blocks.filter("cid != leader").groupBy("cid", "leader").agg(F.sum("weight").alias("weight"))
    ties = ties.groupBy("cid").agg(F.max(F.struct("weight", (-F.col("leader")).alias("l"))).alias("best")).select(F.col("cid").alias("a"), (-F.col("best.l")).alias("b"))
    comps = _merged(comps, found.verified(ties))
    found.clear()
    mixed = _mixed(blocks, comps, found)
    comps = _merged(comps, _tree_links(_mixed(_one_block_each(mixed), comps, found), comps, found))
    found.clear()
    comps = _merged(comps, _tree_links(_mixed(mixed, comps, found), comps, found))
    found.scratch += [found.sets] if found.sets is not None else []
    found.clear()
    named = found.names.join(comps.toDF("c", "comp"), F.col("cid") == F.col("c"), "left").select("digest", "least", F.coalesce("comp", "cid").alias("component"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = found.slim.join(named.select(F.col("digest").alias("d"), "component"), F.col("digest") == F.col("d"), "left").select("id", "th", "n", "component")
    return rows, materialise(least, "least")


def document_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``."""
    rows, least = _named(docs.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("binary").alias("th"), F.col(text_col).alias("text")))
    rows = rows.select("id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("c"))
    named = rows.filter("c IS NOT NULL").join(least, F.col("c") == F.col("component")).select("id", "n_shingles", "component_id")
    return named.unionAll(rows.filter("c IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component, with all their columns: the one with
    the smallest id (a null one is the largest), of rows that share it the one
    whose text has the least digest, of equal rows any.  Documents with empty
    sets all stay."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), digest.alias("th"), F.col(text_col).alias("text"))
    rows, _ = _named(packed)
    members = materialise(rows.filter("component IS NOT NULL").groupBy("component", "id", "th").agg(F.count(F.lit(1)).alias("copies")), "members")
    best = F.struct(F.col("id").isNull().alias("without"), F.col("id").alias("i"), F.col("th").alias("t"))
    keepers = materialise(members.groupBy("component").agg(F.min(best).alias("best")).select(F.col("component").alias("c"), "best.i", "best.t"), "keepers")
    same = (F.col("id").eqNullSafe(F.col("i"))) & (F.col("th") == F.col("t"))
    gone = materialise(members.join(keepers, (F.col("component") == F.col("c")) & same, "left_anti").select(F.col("id").alias("i"), F.col("th").alias("t")), "gone")
    # Only rows whose id may be one of theirs are shuffled with their texts.
    near = marked(packed.drop("text"), F.xxhash64("id"), gone.select(F.xxhash64("i").alias("key")))
    out = near.filter("NOT near").unionAll(near.filter("near").join(gone, same, "left_anti")).drop("near")
    again = members.filter("copies > 1").select(F.col("id").alias("i"), F.col("th").alias("t"))
    if not again.isEmpty():  # rows that repeat id and text
        out = out.join(again, same, "left_anti").unionAll(out.join(again, same, "left_semi").dropDuplicates(["id", "th"]))
    return out.select("row.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE {duck.shingles("d", "documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
